import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("bcdfglmnaeio", k=5))
    line = lambda n: " ".join(word() for _ in range(n))
    clean = [f"{line(30)}\n{line(25)}\n{line(40)}" for _ in range(60)]
    toxic = [f"{line(20)} idiot {line(9)} scum\n{line(9)}" for _ in range(60)]
    shared, passage = line(12), line(15)
    long = line(120)
    near = [clean[1], long, long.replace(long.split(" ")[50], "other")]
    tainted = [f"{line(30)}\n{line(3)} {passage} {line(2)}" for _ in range(3)]
    repeating = [f"{line(30)}\n{shared}\n{line(20)}" for _ in range(4)]
    texts = clean + toxic + near + tainted + repeating + [None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 120)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, f"what {passage} so"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    first: dict[str, int] = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n") if not 60 <= i < 120 else []:
            first.setdefault(x.strip().lower(), i)
    want = {}
    for i, t in enumerate(texts):
        if 60 <= i < 120 or i == 122 or 123 <= i < 126:  # toxic, near copy, benchmark passage
            continue
        want[i] = "\n".join(x for x in (t or "").split("\n") if len(x) < 10 or first[x.strip().lower()] == i)
    assert want[120] == "" and shared in want[126] and shared not in want[127]
    oracle = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got == {i: (len(x := oracle.encode(t, add_special_tokens=False).ids), x) for i, t in want.items()}


def written(spark, path, rows, labels):
    more = "doc_id long, text string, lang string, source string, n_chars long, ids string, gone string, mark string, score string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "0.9") for i, t in rows], more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows, further columns, no labels and no benchmark."""
    same = "one two three four five six seven eight"
    rows = [(1, same), (1, same), (2, same), (None, None), (None, "a line that is long enough"), (3, "a line that is long enough\nmore words here"), (4, ""), (5, "a line that is long enough\nother words there")]
    written(spark, tmp_path, rows, [])
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens > 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    # lines that 1 and 2 share stay in 1; the line that 3 and 5 share goes from 5 and from the row without an id
    assert got == sorted([(False, 1, True), (False, 1, True), (False, 2, False), (False, 3, True), (False, 4, False), (False, 5, True), (True, 0, False), (True, 0, False)], key=repr)


def test_empty_table(spark, tmp_path):
    written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
