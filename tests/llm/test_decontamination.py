"""Containment search against brute force."""

import random

from verdigris.llm.decontamination import contained_items, decontaminate

DOCS, ITEMS = "doc_id long, text string, item_id long, bound long", "item_id long, text string, width int"
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACES:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(w, size):
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()


def brute(docs, items):
    out = set()
    for d, text, *_ in docs:
        for i, item, *_ in items:
            w = words(item)
            size = min(5, len(w))
            want = shingles(w, size)
            have = len(want & shingles(words(text), size))
            if want and 100 * have >= 80 * len(want):
                out.add((d, i, len(want), have))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(11)
    make = lambda n: " ".join(rnd.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rnd.randrange(40)) for _ in range(n))
    items = [(k, make(rnd.randrange(3, 60)), 0) for k in range(40)] + [(40, None, 0), (41, "", 0), (42, "one", 0), (43, "Zwei  drei", 0), (0, "another text with the same id as item null", 0), (None, make(12), 0)]
    docs = []
    for k in range(120):
        w = words(make(rnd.randrange(0, 400)))
        for _ in range(rnd.randrange(3)):
            item = words(rnd.choice(items)[1])
            for _ in range(rnd.randrange(3)):
                if item:
                    item[rnd.randrange(len(item))] = "changed"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = item
        docs.append((k, " \n".join(w).upper() if k % 3 else "\t ".join(w), 5, 6))
    docs += [(500, None, 1, 1), (501, "", 1, 1), (502, "one", 1, 1), (None, items[3][1], 1, 1), (503, " ".join(["x"] * 50_000) + " " + items[5][1], 0, 0)]
    d, i = spark.createDataFrame(docs + docs[:20], DOCS), spark.createDataFrame(items + items[:5], ITEMS)
    got = contained_items(d, i).collect()
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got} == brute(docs, items)
    assert len(got) == len({tuple(r) for r in got})
    assert all(abs(r["containment"] - r["n_shared"] / r["n_item"]) < 1e-12 for r in got)
    gone = {r["doc_id"] for r in got}
    kept = decontaminate(d, i)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((x[0], x[1] or "") for x in docs + docs[:20] if x[0] not in gone)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b c d e f", 0, 0)], DOCS), spark.createDataFrame([(1, "a b c d e f", 0)], ITEMS)
    assert contained_items(d.limit(0), i).count() == 0 and contained_items(d, i.limit(0)).count() == 0
    assert decontaminate(d, i.limit(0)).count() == 1 and decontaminate(d, i).count() == 0
