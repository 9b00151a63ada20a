"""Operator 5 against brute force over tokens."""

import random
import re

from tallywright.llm import decontaminate
from tests.llm import helpers


def brute_tokens(t):
    """(value, kind) of every word, by the rules in words."""
    lists = {k: set(v.split()) for k, v in (("unit", decontaminate.UNITS), ("number", decontaminate.NUMBER_WORDS), ("common", decontaminate.COMMON))}
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")
    large, small = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]"
    shout = [len(w.encode()) > 1 and re.search(large, w) is not None and not re.search(small, w) for w in found]
    loud = 2 * sum(shout) > sum(re.search(f"{large}|{small}", w) is not None for w in found)
    out = []
    for k, w in enumerate(found):
        low = w.translate(helpers.LOW | {i: i + 32 for i in range(0xC0, 0xDF) if i != 0xD7})
        beside = k and shout[k - 1] or k + 1 < len(found) and shout[k + 1]
        opens = len(w) > 1 and "A" <= w[0] <= "Z"
        named = opens and (not beside and not loud if shout[k] else re.match("[a-z\x80-\U0010ffff]", w[1]) is not None)
        if re.fullmatch("[0-9]+", w) or low in lists["number"]:
            kind = "number"
        elif low in lists["unit"] and out and out[-1][1] == "number":
            kind = "unit"
        else:
            kind = "name" if named and low not in lists["common"] else ""
        out.append((low, kind))
    return out


def brute_leaks(rows, items, cover=decontaminate.COVER, window=decontaminate.WINDOW):
    got = set()
    for doc, t in rows:
        words = brute_tokens(t)
        form = [k or w for w, k in words]
        for item, text in items:
            mine = brute_tokens(text)
            size = min(window, len(mine))
            if len(mine) < decontaminate.LEAST_LITERALS or sum(not k for _, k in mine) < decontaminate.LEAST_LITERALS:
                continue
            want = [k or w for w, k in mine]
            hits = sorted((a - p, p) for p in range(len(mine) - size + 1) for a in range(len(words) - size + 1) if sum(not k for _, k in mine[p : p + size]) >= min(decontaminate.LEAST_IN_WINDOW, size) and want[p : p + size] == form[a : a + size])
            groups = []
            for s, p in hits:
                if not groups or s > groups[-1][-1][0] + decontaminate.DRIFT:
                    groups.append([])
                groups[-1].append((s, p))
            for g in groups:
                where = {}
                for s, p in g:
                    for k in range(p, p + size):
                        where.setdefault(k, s)
                pairs = [(mine[k][1], mine[k][0], words[s + k][0]) for k, s in where.items() if mine[k][1]]
                if len(where) >= cover * len(mine) and len({(k, a) for k, a, _ in pairs}) == len({(k, b) for k, _, b in pairs}) == len(set(pairs)):
                    got.add((doc, item))
    return got


def test_decontamination_against_brute_force(spark):
    r = random.Random(9)
    pool = "the train car apple Anna Bob Zurich MIT walks sells buys 3 5 17 km hours apples red each price far how many and then of seven kg".split()
    items = [(k, " ".join(r.choice(pool) for _ in range(r.choice([5, 12, 20, 40])))) for k in range(25)]
    rows = []
    for k in range(120):
        w = r.choice(items)[1].split()
        change = dict(zip(["Anna", "Bob", "Zurich", "3", "5", "17"], r.sample(["Carla", "Dan", "Ulm", "8", "9", "41"], 6))) if k % 3 == 0 else {}
        w = [change.get(x, x) for x in w]
        for _ in range(r.randrange(4)):
            w.insert(r.randrange(len(w) + 1), r.choice(["Indeed", "odd", "GOOD", "99"]))
        a = r.randrange(len(w) // 2 + 1)
        w = w[: len(w) - a] if k % 2 else w[a:]
        rows.append((k, " ".join([r.choice(pool) for _ in range(r.randrange(30))] + w + [r.choice(pool) for _ in range(r.randrange(30))])))
    rows += [(200, "word. " * 900 + items[3][1] + " word" * 900), (201, None), (202, "ALL IN CAPITALS " + items[4][1].upper()), (203, "some prose here " + items[5][1].upper().replace("TRAIN", "ÉTÉ") + " and more prose follows"), (204, items[6][1].upper() + " ÀÉ")]
    rows += helpers.odd_rows(long_words=230_000)[:4] + [(205, " ".join(helpers.words(7, 230_000)) + " " + items[7][1])]
    want = brute_leaks(rows, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = helpers.documents(spark, rows)
    for size in (decontaminate.BLOCK_BYTES, 700):
        assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench, block_bytes=size).collect()} == want
        kept = decontaminate.clean(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - {d for d, _ in want}
    assert 30 < len({d for d, _ in want}) < 115


def test_names_are_slots_wherever_they_stand(spark):
    item = "Anna has 12 apples. The shop sells 7 of them to BOB for 3 euros. How many are left for Anna?"
    texts = ["Peter has 40 apples. The shop sells 9 of them to EVE for 5 euros. How many are left for Peter?", "Peter has 40 apples. The shop sells 9 of them to EVE for 5 euros. How many are left for Carla?", "Anna is here and the shop is closed today because nobody has apples"]
    got = decontaminate.leaks(helpers.documents(spark, list(enumerate(texts))), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.covered == r.tokens) for r in got} == {(0, 1, True)}
