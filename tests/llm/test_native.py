"""Line deduplication and decontamination against brute force, with odd rows."""

import random
import re

from phaseloom.llm import decontaminate as dc
from phaseloom.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_lines(rows):
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = low(x.strip(SPACE))
            if len(k) >= 10 and i is not None:
                held.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(low(x.strip(SPACE)), ())) >= 2 and i != min(held[low(x.strip(SPACE))]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(6)
    pool = ["Common Line ÄÖ number one", "common line äö number one", "  COMMON LINE ÄÖ NUMBER ONE\t", "short", "", "another shared line here", "x" * 10, "x" * 9]
    rows = [(i, "\n".join(rng.choice([*pool, f"own line {rng.random()}"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(None, "another shared line here\nmine"), (None, None), (5, None), (6, ""), (7, "\n\n"), (61, "another shared line here\n" * 3000), (62, rows[3][1]), (3, rows[3][1]), (3, "Another shared line here")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_lines int, kept_text string").selectExpr("*", "1 AS id", "2 AS mark", "3 AS GONE", "4 AS h1", "5 AS _mark", "6 AS parts")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in ld.line_dedup(df).collect()), key=repr)
    assert got == brute_lines(rows)
    assert ld.line_dedup(df.limit(0)).count() == 0
    assert ld.line_dedup(df).columns == ["doc_id", "text", "id", "mark", "GONE", "h1", "_mark", "parts", "n_lines", "n_dropped", "kept_text"]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))


def brute_hits(rows, bench, n):
    wins = {}
    for item, t in bench:
        w = words(t)
        k = min(len(w), n)
        for i in range(len(w) - k + 1) if w else []:
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    hit |= set(range(a, a + k))
                    items |= wins[tuple(w[a : a + k])]
        out.append((i, len(w), tuple(sorted(hit)), tuple(sorted(items))))
    return sorted(out, key=repr)


def test_contamination(spark):
    rng = random.Random(9)
    vocab = ["ab", "Cd", "é", "7", "zz9", "Ñu"]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    bench = [(i, line(rng.choice([0, 1, 2, 3, 9, 10, 11, 25, 40]))) for i in range(14)] + [(99, None), (100, "..."), (1, "ab-ab")]
    rows = [(i, line(rng.choice([0, 3, 12, 60])) + (" -- " + bench[rng.randrange(14)][1].upper().replace(" ", "...") + ". " if rng.random() < 0.6 else "")) for i in range(40)]
    rows += [(None, rows[2][1]), (4, None), (4, ""), (5, rows[5][1]), (6, ",,, "), (7, bench[3][1] * 50)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string")
    b = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, n_words int")
    for n in (10, 5):
        got = sorted(((r.doc_id, r.n_words, tuple(r.hit_words), tuple(r.items)) for r in dc.contamination(docs, b, n).collect()), key=repr)
        assert got == brute_hits(rows, bench, n)
    assert dc.contamination(docs.limit(0), b).count() == 0
    assert sum(len(r.hit_words) for r in dc.contamination(docs, b.limit(0)).collect()) == 0


def test_removal(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"Start {passage} End!", "a"), (2, "clean Text.", "b"), (3, None, "c")], "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in dc.decontaminate(docs, bench).collect()) == [2, 3]
    got = {r.doc_id: (r.text, r.spans) for r in dc.decontaminate(docs, bench, remove="spans").collect()}
    assert got == {1: ("start end", "a"), 2: ("clean Text.", "b"), 3: (None, "c")}
    more = docs.selectExpr("*", "1 AS hit_words", "2 AS words", "3 AS mark", "4 AS own_id", "5 AS items")
    assert {r.doc_id: (r.text, r.hit_words, r.items) for r in dc.decontaminate(more, bench, remove="spans").collect()}[1] == ("start end", 1, 5)
    assert dc.decontaminate(more, bench).columns == more.columns


def test_shuffled_lookup_gives_the_same(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, f"{passage} {i} tail {passage}" if i % 3 else "clean text") for i in range(90)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, "clean text")], "item_id long, text string")
    rows = lambda: sorted((r.doc_id, r.n_words, tuple(r.hit_words), tuple(r.items)) for r in dc.contamination(docs, bench).collect())
    want = rows()
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert rows() == want and len(want) == 90
