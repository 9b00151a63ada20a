"""Warehouse, schemas, telemetry ingest, datasets and streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.plans import gate
from tallywright.sources import datasets, schema, telemetry, warehouse
from tallywright.streaming import windows

DDL = "id long NOT NULL, at timestamp NOT NULL, v double, props variant"


@pytest.fixture
def store(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path), "acme")
    t = w.register("events", T.StructType.fromDDL(DDL), time_column="at", partition_by="hour", sort_keys=("at",), bloom_columns=("id",))
    return w, t


def rows(spark, ids, hour=1):
    return spark.createDataFrame([(i, dt.datetime(2026, 1, 1, hour, i % 60), float(i)) for i in ids], "id long, at timestamp, v double")


def test_write_read_and_idempotence(spark, store):
    w, t = store
    assert w.scan(t).count() == 0
    w.write(t, rows(spark, range(5)), "b1")
    w.write(t, rows(spark, range(5)), "b1")
    w.acknowledge(t, rows(spark, range(5, 8), 2), "b2")
    w.acknowledge(t, rows(spark, range(5, 8), 2), "b2")
    assert w.scan(t).count() == 8 and len(w.manifest(t)) == 1
    assert w.publish(t) == 1 and w.scan(t).count() == 8
    got = w.sql("SELECT count(*) AS n, sum(v) AS s FROM tally.datasets.events WHERE at >= $1::timestamptz", ["2026-01-01 02:00:00"]).first()
    assert tuple(got) == (3, 18.0)
    us = lambda h: int(dt.datetime(2026, 1, 1, h, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    part = w.scan(t, us(2), us(3))
    assert part.count() == 3 and len({f.rsplit("/data/", 1)[1].split("/")[0] for f in part.inputFiles()}) == 1
    assert w.compact(t) == [] and len(w.compact(t, kind="full")) == 1 and len(w.manifest(t)) == 1 and w.scan(t).count() == 8
    assert w.write(t, rows(spark, range(5)), "b1") and w.scan(t).count() == 8
    w.insert(t, [{"id": 9, "at": dt.datetime(2026, 1, 1, 5)}], "b3")
    assert w.scan(t).where("id = 9").first()["v"] is None


def test_time_bounds_reach_the_files(spark, store):
    w, t = store
    w.write(t, rows(spark, range(5)))
    us = int(dt.datetime(2026, 1, 1, 1, 2, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    part = w.scan(t, us, us + 60_000_000)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at," in plan and "LessThan(at," in plan and [r.id for r in part.collect()] == [2]


def test_an_acknowledged_batch_survives(spark, store, tmp_path, monkeypatch):
    w, t = store
    w.acknowledge(t, rows(spark, range(4)), "a/1 %")
    wide = spark.range(40).select("id", F.expr("timestamp'2026-01-01 00:00:00' + make_dt_interval(0, cast(id as int))").alias("at"))
    with pytest.raises(schema.SchemaError, match="partitions"):
        w.write(t, wide, "wide")
    assert w.scan(t).count() == 4 and w.staged(t) == ["a/1 %"]
    commit = w._commit
    monkeypatch.setattr(w, "_commit", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        w.publish(t)
    assert w.scan(t).count() == 4
    monkeypatch.setattr(w, "_commit", commit)
    other = warehouse.Warehouse(spark, str(tmp_path), "acme")
    other.register("events", T.StructType.fromDDL(DDL), time_column="at", partition_by="hour", sort_keys=("at",), bloom_columns=("id",))
    pinned = other.pin(t)
    assert other.scan(t, pinned=pinned).count() == 4 and other.publish(t) == 1 and other.publish(t) == 0
    assert [r["batch_id"] for r in other.manifest(t)] == ["a/1 %"] and w.scan(t).count() == 4


def test_compaction_expiry_and_inventory(spark, store):
    w, t = store
    for k, hour in enumerate((1, 1, 2, 3)):
        w.write(t, rows(spark, range(10 * k, 10 * k + 3), hour), f"b{k}")
    new = w.compact(t, kind="small-files")
    assert len(new) == 1 and {r["batch_id"] for r in w.manifest(t)} == {*new, "b2", "b3"} and w.scan(t).count() == 12
    assert w.expire(t, 0) == 0 and w.expire(t, 2**62) == 2 and w.scan(t).count() == 12
    assert w.rewrite_manifest(t) == 5 and len(w.manifest(t)) == 3 and w.scan(t).count() == 12
    inventory = w.file_list(t).collect()
    assert sum(r.rows for r in inventory) == 12 and all(r.bytes > 0 and r.files > 0 and r.min_us <= r.max_us for r in inventory)
    assert w.compact(t, kind="full") and len(w.manifest(t)) == 1 and w.scan(t).count() == 12
    with pytest.raises(schema.SchemaError):
        w.compact(t, kind="odd")


def _files(w, t):
    """Per published data file: (time, id) of its rows as they stand there."""
    import pyarrow.parquet as pq

    found = [f.removeprefix("file://") for r in w.manifest(t) for f in w._read([r["path"]], t.stored).inputFiles()]
    return [[(x["at"], x["id"]) for x in pq.ParquetFile(f).read(["at", "id"]).to_pylist()] for f in found]


def test_a_commit_of_one_partition_is_divided(spark, store, monkeypatch):
    w, t = store
    monkeypatch.setattr(warehouse, "RANGE_ROWS", 100)
    for k in range(2):
        # one hour, and half of the rows at one instant
        w.write(t, spark.range(500 * k, 500 * k + 500, 1, 3).select("id", F.expr("timestamp'2026-01-01 01:00:00' + make_dt_interval(0, 0, 0, if(id % 2 = 0, 0, id))").alias("at"), F.col("id").cast("double").alias("v")), f"b{k}")
    w.compact(t, kind="full")
    files = _files(w, t)
    assert len(files) == w.manifest(t)[0]["files"] - 1 == 10 and max(map(len, files)) <= 200
    assert sorted(i for f in files for _, i in f) == list(range(1000)) and all([a for a, _ in f] == sorted(a for a, _ in f) for f in files)
    spans = sorted((f[0][0], f[-1][0]) for f in files)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    monkeypatch.setattr(warehouse, "RANGE_ROWS", 10**6)
    monkeypatch.setattr(warehouse, "RANGE_BYTES", w.manifest(t)[0]["bytes"] // 3 + 1)
    w.compact(t, kind="full")
    assert len(_files(w, t)) == 3 and sorted(r.id for r in w.scan(t).select("id").collect()) == list(range(1000))


DATA = "/root/testdata/sf0.001"


def test_a_window_over_a_divided_month(spark, monkeypatch):
    monkeypatch.setattr(warehouse, "RANGE_ROWS", 50)
    got = warehouse.warehouse_window(spark, DATA)
    want = spark.read.parquet(f"{DATA}/events.parquet").where("ts >= timestamp'2024-01-03' and ts < timestamp'2024-01-09'").select("event_id", "ts")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())
    counts = [r["count"] for r in spark.read.parquet(*got.inputFiles()).groupBy(F.input_file_name()).count().collect()]
    assert len(counts) >= 4 and max(counts) <= 100


def test_a_live_union_over_divided_batches(spark, monkeypatch):
    monkeypatch.setattr(warehouse, "RANGE_ROWS", 50)
    got = warehouse.warehouse_live_union(spark, DATA)
    want = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "value")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # one compacted batch of half of the rows, two staged ones
    assert len([f for f in got.inputFiles() if "/data/batch=compact-" in f]) >= want.count() // 2 // 50


def test_outcomes(spark, store, monkeypatch):
    w, t = store
    w.write(t, rows(spark, range(3)))
    w.acknowledge(t, rows(spark, [7]))
    got, end = w.collect("SELECT count(*) AS n FROM tally.datasets.events")
    assert got["n"].to_pylist() == [4] and end.outcome == "success" and not end.warnings
    listing = w.staged
    monkeypatch.setattr(w, "staged", lambda table: (_ for _ in ()).throw(OSError("gone")))
    got, end = w.collect("SELECT count(*) AS n FROM tally.datasets.events")
    assert got["n"].to_pylist() == [3] and end.outcome == "degraded" and len(end.warnings) == 1
    monkeypatch.setattr(w, "staged", listing)
    df = w.sql("SELECT id FROM tally.datasets.events")
    w._delete(f"{w._dir(t)}/data")
    got, end = gate.Running(spark).collect(df)
    assert got is None and end.outcome == "failed"


def test_statements_reach_only_own_tables(spark, store, tmp_path):
    w, t = store
    w.register("other", T.StructType.fromDDL("id long, at timestamp"), time_column="at")
    foreign = str(tmp_path / "foreign")
    spark.range(5).write.parquet(foreign)
    spark.sql("CREATE TABLE IF NOT EXISTS gate_target (id BIGINT) USING parquet")
    own = "tally.datasets.events"
    for bad in (f"WITH t AS (SELECT 1 AS id) INSERT INTO gate_target SELECT id FROM t", f"EXPLAIN SELECT 1 FROM {own}", f"SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM {own}", f"SELECT * FROM IDENTIFIER('{own}')", f"SELECT * FROM read_files('/x')", "SHOW TABLES", f"FROM {own} INSERT INTO gate_target SELECT id"):
        with pytest.raises(gate.Refused):
            w.sql(bad)
    for bad in (f"SELECT o.id FROM {own} e, parquet.`{foreign}` o", f"WITH x AS (TABLE parquet.`{foreign}`) SELECT * FROM x", f"SELECT (SELECT max(id) FROM parquet.`{foreign}`) FROM {own}", f"SELECT * FROM {own} WHERE id IN (SELECT id FROM gate_target)", "WITH gate_target AS (SELECT 1 AS id), b AS (SELECT 1) SELECT * FROM spark_catalog.default.gate_target", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a"):
        with pytest.raises(PermissionError):
            w.sql(bad)
    assert spark.table("gate_target").count() == 0
    w.write(t, rows(spark, range(4)))
    w.write(w.tables["tally.datasets.other"], spark.createDataFrame([(2, dt.datetime(2026, 1, 1))], "id long, at timestamp"))
    assert w.sql(f"SELECT e.id FROM {own} e, tally.datasets.other o WHERE e.id = o.id").first()[0] == 2
    assert w.sql(f"SELECT tally.datasets.events.id FROM {own}, \"tally.datasets.other\" o WHERE tally.datasets.events.id = o.id").first()[0] == 2
    assert w.sql(f"WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT count(*) FROM r, (TABLE {own}) x").first()[0] == 12
    spark.sql("DROP TABLE gate_target")


def test_refusals(spark, store):
    w, t = store
    with pytest.raises(schema.SchemaError, match="undeclared"):
        w.write(t, rows(spark, [1]).withColumn("more", F.lit(1)))
    with pytest.raises(schema.SchemaError, match="missing"):
        w.write(t, rows(spark, [1]).drop("at"))
    with pytest.raises(schema.SchemaError, match="^already exists$"):
        w.register("events", T.StructType.fromDDL(DDL))
    with pytest.raises(schema.SchemaError, match="another schema"):
        w.register("events", T.StructType.fromDDL("id long"))
    for bad in ("", "a..b", "/x", ".a", "a.", "x" * 64, "a b"):
        with pytest.raises((schema.SchemaError, IndexError)):
            schema.check_name(bad)
    for ddl in ("run_id string", "tally_x long", "a long, A long"):
        with pytest.raises(schema.SchemaError):
            schema.check_columns(T.StructType.fromDDL(ddl))
    with pytest.raises(PermissionError):
        w.sql("SELECT 1 FROM tally.datasets.nope")
    with pytest.raises(PermissionError):
        w.sql("SELECT 1 FROM tally.datasets.events", caller=gate.Caller("other"))
    with pytest.raises(gate.Refused):
        w.sql("DELETE FROM tally.datasets.events")


def test_built_in_tables_are_empty_and_hide_sensitive_columns(spark, store):
    w, _ = store
    for name in schema.BUILT_IN:
        assert w.sql(f"SELECT count(*) FROM {name}").first()[0] == 0
    with pytest.raises(Exception, match="attributes"):
        w.sql("SELECT attributes FROM tally.traces.spans", caller=gate.Caller("acme"))
    assert [f.name for f in schema.BUILT_IN["tally.traces.spans"].stored.fields][-7:] == schema.MANAGED.names


def test_alteration():
    t = schema.Table("datasets", "x", T.StructType.fromDDL("id long, at timestamp"), schema.Layout("at", "day", ("id",)))
    n = schema.alter(t, 1, add=T.StructType.fromDDL("more string"), rename={"at": "time", "id": "key"})
    assert n.schema.names == ["key", "time", "more"] and n.layout.time_column == "time" and n.layout.sort_keys == ("key",) and n.version == 2
    for kw in ({"expected_version": 2}, {"add": T.StructType.fromDDL("z long NOT NULL")}, {"add": T.StructType.fromDDL("id long")}, {"rename": {"no": "yes"}}, {"layout": schema.Layout("nope")}, {"layout": schema.Layout("at", "")}):
        with pytest.raises(schema.SchemaError):
            schema.alter(t, kw.pop("expected_version", 1), **kw)
    with pytest.raises(schema.SchemaError):
        schema.alter(schema.BUILT_IN["tally.logs.records"], 1, add=T.StructType.fromDDL("z long"))
    a, b = T.StructType.fromDDL("s struct<x: long>"), T.StructType.fromDDL("s struct<y: long>")
    assert schema.fingerprint(a) == schema.fingerprint(b) and schema.fingerprint(a, True) != schema.fingerprint(b, True)


def test_time_pruning_fails_open():
    assert not warehouse.may_hold(10, 20, 21, 30) and not warehouse.may_hold(10, 20, 0, 10)
    assert warehouse.may_hold(10, 20, 20, 30) and warehouse.may_hold(None, 20, 90, 99) and warehouse.may_hold(20, 10, 90, 99)


def test_every_type_round_trip(spark, store, tmp_path):
    ddl = "id long, flag boolean, i32 int, f32 float, d decimal(38,9), day date, ntz timestamp_ntz, utc timestamp, ns long, b binary, xs array<long>, p struct<x: long, label: string>, m map<string, long>, v variant, big decimal(20,0)"
    src = spark.sql("SELECT 1L id, true flag, 2 i32, 1.5f f32, 1.000000001BD d, date'2026-01-01' day, timestamp_ntz'2026-01-01 00:00:00' ntz, timestamp'2026-01-01 00:00:00' utc, 5L ns, X'0102' b, array(1L, null) xs, named_struct('x', null, 'label', 'a') p, map('k', null) m, parse_json('{\"n\": 18446744073709551615}') v, 18446744073709551615BD big UNION ALL SELECT 2, null, null, null, null, null, null, null, null, null, null, null, null, null, null")
    src = src.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(ddl).fields])
    src.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.dtypes == src.dtypes
    one, two = back.orderBy("id").collect()
    assert one.p.label == "a" and one.p.x is None and two.p is None and one.xs == [1, None] and one.v.toJson() == '{"n":18446744073709551615}'


def test_telemetry_validation(spark):
    names = [f for f in schema.BUILT_IN["tally.metrics.points"].schema.fields if f.name in "metric_type int_value double_value histogram_count bucket_counts explicit_bounds exponential_scale positive_buckets negative_buckets summary_count quantile_values exemplars".split()]
    s = T.StructType([T.StructField(f.name, f.dataType, True) for f in names if f.name != "exemplars"])
    order = s.names

    def row(**k):
        return tuple(k.get(n) for n in order)

    good = [row(metric_type="gauge", double_value=1.0), row(metric_type="histogram", histogram_count=3, bucket_counts=[1, 2], explicit_bounds=[0.5]), row(metric_type="exponential_histogram", histogram_count=1, exponential_scale=2), row(metric_type="summary", summary_count=1, quantile_values=[(0.5, 1.0)])]
    bad = [row(metric_type="sum"), row(metric_type="histogram"), row(metric_type="histogram", histogram_count=3, bucket_counts=[1], explicit_bounds=[0.5]), row(metric_type="histogram", histogram_count=1, exponential_scale=1), row(metric_type="exponential_histogram", histogram_count=1), row(metric_type="summary", summary_count=1), row(metric_type="summary", summary_count=1, quantile_values=[(1.5, 1.0)]), row(metric_type="odd")]
    df = spark.createDataFrame(good + bad, s).withColumn("exemplars", F.expr("cast(array() as array<struct<span_id:binary,trace_id:binary>>)"))
    ok, no = telemetry.partial_success(df, telemetry.metric_defect())
    assert (ok.count(), no.count()) == (len(good), len(bad))
    spans = spark.createDataFrame([("r", 2, "a", 1, 5, 4, bytearray(16), bytearray(8)), ("r", 1, "", 1, 5, 4, bytearray(16), bytearray(8)), ("r", 3, "b", 5, 1, -4, bytearray(16), bytearray(8)), ("r", 4, "c", 1, 5, 9, bytearray(16), bytearray(8)), ("r", 5, "d", 1, 5, 4, bytearray(16), bytearray(8))], "request_id string, seq int, name string, start_time_unix_nano long, end_time_unix_nano long, duration_nano long, trace_id binary, span_id binary")
    ok, no = telemetry.partial_success(spans, telemetry.span_defect(), "seq")
    assert [(r.name, r.ordinal) for r in ok.orderBy("seq").collect()] == [("a", 0), ("d", 1)] and no.count() == 3


def test_promoted_columns(spark):
    df = spark.createDataFrame([('{"http.route": "/x", "http.response.status_code": 500, "exception.type": ""}',), ('{"http.route": 5, "http.response.status_code": "500"}',)], "j string").select(F.parse_json("j").alias("attributes"))
    a, b = telemetry.promote(df).collect()
    assert (a.http_route, a.http_response_status_code, a.exception_type) == ("/x", 500, "") and (b.http_route, b.http_response_status_code) == (None, None)
    assert [r[0] for r in telemetry.promote(df).select(telemetry.log_is_exception()).collect()] == [True, False]
    with pytest.raises(Exception, match="differs"):
        telemetry.promote(df.withColumn("http_route", F.lit("/y"))).collect()
    logs = spark.createDataFrame([('"text"', ""), ("5", "e")], "j string, event_name string").select(F.parse_json("j").alias("body"), "event_name")
    assert [(r.body_text, r.event_name) for r in telemetry.log_columns(logs).collect()] == [("text", None), (None, "e")]


def test_datasets(spark, tmp_path):
    df = spark.range(50).withColumn("s", F.concat(F.lit("é"), F.col("id").cast("string")))
    for kind, codec in (("parquet", "zstd"), ("jsonl", "gzip"), ("csv", "none")):
        path = str(tmp_path / kind)
        datasets.save(df, path, kind, codec, rows_per_file=20)
        back = datasets.open_dataset(spark, path, kind, df.schema)
        assert datasets.stats(back).first() == datasets.stats(df).first()
    assert [r.id for r in datasets.split_by_range(df, ("id",), 10, 13).collect()] == [10, 11, 12]
    assert [r.id for r in datasets.split_by_indices(df, ("id",), [0, 49]).collect()] == [0, 49]
    files = spark.createDataFrame([("a.csv", b"x,y\n1,\"a,b\"\n"), ("b.json", b'{"k": 1}'), ("c.json", b"{"), ("d.txt", b"\xff"), ("e.pdf", b"%PDF")], "path string, content binary")
    got = {r.path: (r.document, r.status) for r in datasets.extract(files).collect()}
    assert got["a.csv"] == ('{"format":"csv","rows":[["x","y"],["1","a,b"]]}', "ok") and got["b.json"][0] == '{"format":"json","value":{"k":1}}'
    assert {k for k, v in got.items() if v[1] == "inconclusive"} == {"c.json", "d.txt", "e.pdf"}


def _archive(parts):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark):
    import json

    from tallywright.sources import office

    w, s, d, p, r = (f'xmlns="{n[1:-1]}"' for n in (office.WORD, office.SHEET, office.DRAW, office.SLIDE, office.LINK))
    ref = f'xmlns:r="{office.REF[1:-1]}"'

    def rels(**to):
        return f"<Relationships {r}>" + "".join(f'<Relationship Id="{k}" Type="x/{kind}" Target="{t}"/>' for k, (kind, t) in to.items()) + "</Relationships>"

    wns, dns = f'xmlns:w="{office.WORD[1:-1]}"', f'xmlns:a="{office.DRAW[1:-1]}"'
    word = f'<w:document {wns}><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p><w:r><w:t>hidden</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    book = {
        "xl/workbook.xml": f'<workbook {s} {ref}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(r1=("worksheet", "worksheets/sheet1.xml")),
        "xl/sharedStrings.xml": f"<sst {s}><si><t>shared</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="b"><v>1</v></c><c r="D1"/></row><row><c r="A2" t="e"><v>#DIV/0!</v></c><c r="B2"><v>45000.5</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    }
    shape = lambda kind, text: f'<sp><nvSpPr><nvPr><ph type="{kind}"/></nvPr></nvSpPr><txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></txBody></sp>'
    show = {
        "ppt/presentation.xml": f'<presentation {p} {ref}><sldIdLst><sldId r:id="r2"/><sldId r:id="r1"/></sldIdLst></presentation>',
        "ppt/_rels/presentation.xml.rels": rels(r1=("slide", "slides/s1.xml"), r2=("slide", "slides/s2.xml")),
        "ppt/slides/s1.xml": f"<sld {p} {dns}>{shape('body', 'only')}</sld>",
        "ppt/slides/s2.xml": f"<sld {p} {dns}>{shape('title', 'Head')}{shape('body', 'text')}<a:tbl><a:tr><a:tc><a:p><a:r><a:t>c</a:t></a:r></a:p></a:tc><a:tc hMerge='1'><a:p/></a:tc></a:tr></a:tbl></sld>",
        "ppt/slides/_rels/s2.xml.rels": rels(r1=("notesSlide", "../notes/n.xml")),
        "ppt/notes/n.xml": f"<notes {p} {dns}>{shape('body', 'said')}</notes>",
    }
    files = spark.createDataFrame([("a.docx", _archive({"word/document.xml": word})), ("b.xlsx", _archive(book)), ("c.pptx", _archive(show)), ("d.docx", b"no zip"), ("e.xlsx", _archive({"x": "y"})), ("f.docx", _archive({"word/document.xml": "<broken"}))], "path string, content binary")
    got = {x.path: x for x in datasets.extract(files).collect()}
    assert json.loads(got["a.docx"].document)["blocks"] == [{"kind": "paragraph", "text": "One\ttwo", "style": "Title"}, {"kind": "paragraph", "text": "", "style": None}, {"kind": "table", "rows": [["wide", ""], ["a", ""]]}]
    cells = {c["address"]: (c["value"], c["formula"], c["error"]) for c in json.loads(got["b.xlsx"].document)["sheets"][0]["cells"]}
    assert cells == {"A1": ("shared", None, None), "B1": (2, "1+1", None), "C1": (True, None, None), "A2": (None, None, "#DIV/0!"), "B2": (45000.5, None, None), "C2": ("in", None, None)}
    one, two = json.loads(got["c.pptx"].document)["slides"]
    assert (one["title"], one["paragraphs"], one["tables"], one["notes"]) == ("Head", ["text"], [{"rows": [["c", ""]]}], "said") and (two["number"], two["title"], two["paragraphs"], two["notes"]) == (2, None, ["only"], "")
    assert all(got[k].status == "inconclusive" and got[k].reason for k in ("d.docx", "e.xlsx", "f.docx"))


def test_array_files(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") / 4).alias("x")).repartition(3)
    for kind in ("arrow", "npz"):
        datasets.save(df, str(tmp_path / kind), kind)
        datasets.save(df, str(tmp_path / kind), kind)
        assert datasets.stats(datasets.open_dataset(spark, str(tmp_path / kind), kind, df.schema)).first() == datasets.stats(df).first()
    datasets.save(df.select("x"), str(tmp_path / "npy"), "npy")
    assert datasets.open_dataset(spark, str(tmp_path / "npy"), "npy", "x double").agg(F.sum("x")).first()[0] == df.agg(F.sum("x")).first()[0]
    with pytest.raises(ValueError):
        datasets.save(df, str(tmp_path / "bad"), "npy")
    twice = df.unionByName(df)
    assert datasets.stats(twice).first()["digest"] != datasets.stats(df.limit(0)).first()["digest"] != datasets.stats(df).first()["digest"]


def test_array_files_are_written_by_the_tasks(spark, tmp_path, monkeypatch):
    import io
    import zipfile

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(datasets, "FILE_BYTES", 100_000)
    df = spark.range(0, 60_000, 1, 2).select("id", (F.col("id") / 4).alias("x"))
    listed = spark.sparkContext.statusTracker()
    for kind in ("arrow", "npz", "npy"):
        src = df if kind != "npy" else df.select("id")
        for _ in range(2):
            spark.sparkContext.setJobGroup(f"save {kind}", "")
            datasets.save(src, str(tmp_path / kind), kind)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        # one job a call, none for each partition that the driver fetches
        assert len(listed.getJobIdsForGroup(f"save {kind}")) == 2
        files = sorted((tmp_path / kind).glob("[!._]*"))
        assert len(files) > 2 and all(f.suffix == f".{kind}" and f.stat().st_size < 200_000 for f in files)
        ids = []
        for f in files:
            data = f.read_bytes()
            if kind == "arrow":
                ids += pa.ipc.open_file(pa.BufferReader(data)).read_all()["id"].to_pylist()
            elif kind == "npz":
                assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
                with np.load(f) as got:
                    assert (got["x"] * 4 == got["id"]).all()
                    ids += got["id"].tolist()
            else:
                ids += np.load(f, mmap_mode="r").tolist()
        assert sorted(ids) == list(range(60_000))
        assert datasets.stats(datasets.open_dataset(spark, str(tmp_path / kind), kind, src.schema)).first() == datasets.stats(src).first()
        datasets.save(src.where("id < 0"), str(tmp_path / kind), kind)
        assert not list((tmp_path / kind).glob("[!._]*")) and datasets.open_dataset(spark, str(tmp_path / kind), kind, src.schema).count() == 0


def test_streams(spark, store, tmp_path):
    w, t = store
    src = tmp_path / "in"
    rows(spark, range(10)).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("id long, at timestamp, v double").parquet(str(src))
    for _ in range(2):
        q = windows.ingest(windows.deduplicated(stream, "id", "at", "1 hour"), w, t, str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert w.scan(t).count() == 10
    agg = windows.tumbling(stream, "at", "5 minutes", [F.count("*").alias("n")])
    q = agg.writeStream.format("memory").queryName("slots").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n), count(*) FROM slots").first()[:] == (10, 2)
    s = windows.sessions(spark.createDataFrame([("u", dt.datetime(2026, 1, 1, 0, m)) for m in (0, 5, 30)], "u string, at timestamp"), "u", "at", "10 minutes", [F.count("*").alias("n")])
    assert sorted(r.n for r in s.collect()) == [1, 2]
    g = windows.ordered_group(spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "k string, o int, v string"), "k", ("o",), "v")
    assert g.first()["items"] == ["a", "b"]
