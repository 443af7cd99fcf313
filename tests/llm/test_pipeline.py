"""Every stage of the corpus pipeline against a brute-force version of its decisions."""

import re

import pytest
from test_operators import WORD, brute_force, most_similar

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "best_fit_packing"]
    assert all(list(s.columns) == COLUMNS for s in stages[:-1])


def test_language_id(stages):
    before, after = stages[0], stages[1]
    assert set(after["doc_id"]) == {i for i, t in zip(before["doc_id"], before["text"], strict=True) if t and re.search(r"[^\W\d_]", t)}


def test_near_dedup(stages):
    before, after = stages[1], stages[2]
    want = brute_force(dict(zip(before["doc_id"], before["text"], strict=True)), 80)
    assert sorted(after["doc_id"]) == sorted(i for i, (_, c) in want.items() if i == c)


def test_decontaminate(stages, spark, small):
    before, after = stages[2], stages[3]
    items = [WORD.findall((r.text or "").lower()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    dirty = {i for i, t in zip(before["doc_id"], before["text"], strict=True) if any(set(w) <= set(ws) and most_similar(ws, w) >= 0.8 for ws in [WORD.findall(t.lower())] for w in items)}
    assert dirty and set(after["doc_id"]) == set(before["doc_id"]) - dirty


def test_secret_scan(stages):
    before, after = stages[3].set_index("doc_id"), stages[4].set_index("doc_id")
    assert set(before.index) == set(after.index)
    secret = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""", re.I | re.A)
    for i, row in after.iterrows():
        assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", row["text"])
        assert row["n_chars"] == len(row["text"])
        if not secret.search(before["text"][i]) and "[SECRET]" not in row["text"]:
            assert row["text"] == before["text"][i]


def test_packing(stages):
    assert set(stages[5]["doc_id"]) == set(stages[4]["doc_id"])
    assert stages[5].groupby("sequence_id")["length"].sum().max() <= 4096


def test_repeated_rows(spark, small):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, "other words in this text", "en", "s", 24)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == [1, 3]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_null_and_repeated_ids_in_near_dedup(spark, small):
    letters = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    near = letters("n", 80)
    rows = [(1, letters("a")), (None, letters("a")), (None, letters("b")), (None, near), (None, near + " more"), (7, letters("c")), (7, letters("d")), (5, letters("d")), (None, None), (None, None), (None, "")]
    got = kept(corpus_pipeline.near_dedup(spark, frame(spark, rows), small))
    one = [x for x in got if x[1] and x[1].startswith(near)]
    assert len(one) == 1 and one[0][0] is None  # near copies, all without an id
    assert [x for x in got if x not in one] == sorted([(1, letters("a")), (None, letters("b")), (7, letters("c")), (5, letters("d")), (None, None), (None, "")], key=str)


def test_null_and_repeated_ids_in_decontaminate(spark, small, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"before {item} after"), (None, "clean text without an id"), (3, item), (3, "clean text of the same id"), (4, None), (None, None)]
    got = kept(corpus_pipeline.decontaminate(spark, frame(spark, rows), str(tmp_path)))
    assert got == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)


def test_run(spark, small, stages):
    got = corpus_pipeline.run(spark, small).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, stages[5][key].to_numpy().tolist()))


CLASHING = ["_t", "_runs", "_gone", "_again", "_row", "row", "number", "gone", "rank", "id", "label", "new"]


def edge_rows():
    long = "word and other words of a long text " * 600_000  # over 20 MB
    rows = [(1, "a text in plain words that says little", "en"), (2, None, "en"), (None, "no id but words of its own here", None), (3, "", None), (4, "12345 !!!", "en"), (5, long, "en"), (6, "same words for both of these rows", "en"), (6, "same words for both of these rows", "en"), (6, "other words under the same number here", None)]
    return [(i, t, lang, "s", None if t is None else len(t), *["!"] * len(CLASHING)) for i, t, lang in rows]


@pytest.mark.parametrize("labelled", [True, False])
def test_every_stage_on_edges(spark, small, labelled):
    rows = edge_rows()
    if not labelled:
        rows = [(*r[:2], None, *r[3:]) for r in rows]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in CLASHING)).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, small)
    assert told.columns == docs.columns and told.count() == 6  # with a letter
    assert {r.lang for r in told.select("lang").collect()} == ({"en"} if labelled else {None})
    if not labelled:
        return
    kept = stages["near_dedup"](spark, docs, small)
    assert kept.columns == docs.columns and kept.count() == 8
    for name in ("decontaminate", "secret_scan"):
        out = stages[name](spark, docs, small)
        assert out.columns == docs.columns and sorted((hash(r) for r in out.collect())) == sorted(hash(r) for r in docs.collect()), name
    packed = stages["best_fit_packing"](spark, docs, small).toPandas()
    assert (packed["piece"] == 0).sum() == len(rows) and packed.groupby("sequence_id")["length"].sum().max() <= 4096
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name


def test_near_dedup_at_four_fifths(spark, small):
    words = [f"w{i}" for i in range(250)]
    near = list(words)
    for i in range(5):
        near[20 + 45 * i] = f"new{i}"
    share = lambda a, b: len(a & b) / len(a | b)
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, near)]
    assert 0.80 <= share(*sets) < 0.85
    got = kept(corpus_pipeline.near_dedup(spark, frame(spark, [(1, " ".join(words)), (2, " ".join(near))]), small))
    assert [i for i, _ in got] == [1]
