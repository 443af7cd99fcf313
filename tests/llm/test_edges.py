"""Null values in any column, empty and very long texts, repeated rows, empty tables, and extra columns with clashing names."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import chat, decontam, dedup, language, licenses, mpeg, packing, quality, secrets, sharding

LONG = "lorem ipsum dolor sit amet " * 20000
CLASHING = ["shard", "slot", "key", "bin", "node", "open", "score", "predicted", "held_out", "spans", "size", "n", "start", "h", "label", "band", "_t", "_n", "_key", "_bucket", "_base", "_id", "digest", "ws", "_runs", "row", "t", "number", "new", "every", "random"]


def rows():
    texts = [(1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (None, "no id here at all, none"), (5, LONG), (6, "same text"), (7, "same text"), (6, "same text"), (8, "été ñandú größe"), (9, "12345 !!!"), (10, "x"), (None, None)]
    return [(i, t, lang, s, None if t is None else len(t)) for (i, t), lang, s in zip(texts, ["en", None, "en", None, "en", "la", "en", "en", "en", "es", None, None, None], ["a", None] * 7, strict=False)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    wide = SCHEMA + "".join(f", `{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["!"] * len(CLASHING)) for r in rows()], wide)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, None), (7, None, 0), (None, 1, 1), (1, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "two three four five six"), (2, None), (None, ""), (3, "x"), (4, "same text"), (4, "same text"), (5, "lorem ipsum dolor sit amet lorem ipsum")], "item_id long, text string")


def all_operators(docs, labels, bench):
    spark = docs.sparkSession
    return {
        "quality": quality.score(docs, quality.train(docs, labels)),
        "language": language.identify(docs, language.train(docs)),
        "decontam": decontam.contaminated(docs, bench),
        "sharding": sharding.assign_shards(docs, sharding.balanced_tree(8)),
        "mpeg": mpeg.digests(docs),
        "media": mpeg.describe(mpeg.store(docs)),
        "secrets": secrets.scan_secrets(docs, secrets.train(secrets.labelled_samples(docs))),
        "packing": packing.pack(docs),
        "licenses": licenses.scan_licenses(docs, licenses.known_digests(spark)),
        "dedup": dedup.near_duplicates(docs),
    }


def test_one_row_per_document(docs, labels, bench):
    n = len(rows())
    for name, df in all_operators(docs, labels, bench).items():
        got = df.toPandas()
        if name == "decontam":
            assert set(zip(got["doc_id"], got["item_id"], strict=True)) == {(1, 1), (5, 5), (6, 4), (7, 4), (10, 3)}
        elif name == "packing":
            assert (got["piece"] == 0).sum() == n
            assert got.groupby("sequence_id")["length"].sum().max() <= 4096
        else:
            assert len(got) == n, name
            assert got["doc_id"].isna().sum() == 2, name


def test_empty_tables(empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nothing = spark.createDataFrame([], "item_id long, text string")
    for name, df in all_operators(empty, none, nothing).items():
        assert df.count() == 0, name


def test_empty_benchmark(docs, spark):
    assert decontam.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_defined_results(docs, labels):
    found = {(r.doc_id, r.n_shingles): r for r in dedup.near_duplicates(docs).collect()}
    assert found[2, 0].component_id == 2 and found[3, 0].component_id == 3 and found[4, 0].kept
    assert found[7, 1].component_id == 6 and not found[7, 1].kept
    said = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert {k for k, r in said.items() if r.lang_pred == "und"} == {2, 3, 4, 9, None} or said[9].lang_pred == "und"
    q = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert q[2] == q[3] and all(0 <= x <= 1 for x in q.values())
    s = {r.doc_id: r for r in sharding.assign_shards(docs, sharding.balanced_tree(8)).collect()}
    assert s[2].size == s[3].size == 1 and s[2].text_crc32 == 0


def rows_of_chat(df):
    return sorted(((r.conv_id, r.n_turns, r.n_copies, r.chat) for r in df.collect()), key=str)


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", None), (2, 0, "user", "hi"), (3, None, None, "x"), (3, 0, "user", ""), (None, 0, "user", "hi"), (None, 0, "z", "hi"), (4, 0, "user", "<|end|>"), (5, 0, "user", "<|end|>"), (6, 0, "a", "b"), (6, 0, "a", "b")]
    wide = spark.createDataFrame([(*t, "!", "!") for t in turns], "conv_id long, turn long, role string, text string, n string, chat string")
    got = {r.conv_id: r for r in chat.maximal_conversations(wide).collect()}
    assert set(got) == {None, 1, 3, 4, 6}
    assert got[1].chat == "<|user|>\nhi\n<|end|>\n<|bot|>\n\n<|end|>\n"
    assert got[None].chat == "<|z|>\nhi\n<|end|>\n"
    assert got[4].n_copies == 2 and "<\\|end|\\>" in got[4].chat
    assert got[6].n_turns == 2
    assert chat.maximal_conversations(wide.limit(0)).count() == 0


def test_chat_keeps_different_conversations_apart(spark):
    turns = [(1, 0, "u|>\nx", "y"), (2, 0, "u", "x|>\ny"), (3, 0, "u", "<|q"), (4, 0, "u", "< |q"), (5, 0, "u", "<\\|q"), (6, 0, "long", "word " * 200_000)]
    got = rows_of_chat(chat.maximal_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 6] and len({r[3] for r in got}) == 6


def canonical(text):
    """The canonical form, by lines and words instead of patterns over the whole text."""
    out = []
    for line in text.lower().split("\n"):
        lead = line.lstrip(" \t*#/-;.")
        if lead.startswith(("copyright (c)", "copyright 1", "copyright 2", "copyright ©", "(c) 1", "(c) 2", "© 2", "copyright: ", "copyright by ")):
            continue
        if lead.rstrip(" .*/#") == "all rights reserved":
            continue
        for mark in ("1. ", "2. ", "3. ", "* ", "- ", "(a) ", "a) "):
            if line.strip().startswith(mark):
                line = line.strip()[len(mark) :]
        out.append(line)
    text = " ".join(out).replace("licence", "license").replace("&", " and ").replace("https://", "http://").replace("non-infringement", "noninfringement").replace("copyright holders", "copyright holder").replace("copyright owner", "copyright holder")
    return " ".join("".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in text).split())


def test_altered_licenses(spark):
    import hashlib
    import os
    import textwrap

    from alphaloom.llm.license_texts import DIGESTS, KNOWN

    cases, want = [], []

    def case(text, expected):
        cases.append((len(cases), text))
        want.append(expected)

    mit, bsd = KNOWN["MIT"], KNOWN["BSD-3-Clause"]
    case("Copyright (c) 2019-2024 Jane Doe <jane@example.org>\n\n" + mit, "MIT")
    case("MIT Licence\n\nCopyright © 2020, Example GmbH. All rights reserved.\n\n" + mit, "MIT (titled)")
    case(mit.upper(), "MIT")
    case("\n".join(textwrap.wrap(mit.replace("\n", " "), 40)), "MIT")
    case("\n".join("# " + x for x in textwrap.wrap(mit.replace("\n", " "), 60)), "MIT")
    case(mit.replace('"', "'").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), "MIT")
    case("Copyright (c) 1999 A\nCopyright (c) 2001 B\nAll rights reserved.\n\n" + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause")
    case(mit.replace("publish, ", ""), None)
    case(mit + " And one more sentence.", None)
    case("Some code before. " + mit, None)
    case(bsd.replace("promote products", "sell products"), None)
    case("", None)
    case(None, None)
    case(" .,;!\n", None)
    case("x" * 20_000_000, None)
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1", "LGPL-2.1")):
        if os.path.exists(path := f"/usr/share/common-licenses/{file}"):
            with open(path, encoding="utf-8") as f:
                text = f.read()
            case(text, name)
            case(" ".join(text.upper().split(" ")), name)
            case(text.replace("License", "Agreement", 1), None)
    docs = spark.createDataFrame(cases, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()}
    assert [got[i].license_id for i in range(len(cases))] == want
    for i, text in cases[:11]:
        assert got[i].digest == hashlib.md5(canonical(text).encode()).hexdigest(), i
    assert len(DIGESTS) > 20
    own = licenses.known_digests(spark, spark.createDataFrame([("House", "Do as you like. Copyright 2020 us"), ("None", "...")], "license_id string, text string"))
    assert [r.license_id for r in licenses.scan_licenses(spark.createDataFrame([(1, "do as you like")], "doc_id long, text string"), licenses.known_digests(spark, {"House": "Do as you like."})).collect()] == ["House"]
    assert own.count() == 1


def test_redaction_keeps_columns_that_clash(docs, spark):
    got = secrets.redact(docs, secrets.train(secrets.labelled_samples(docs)))
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_written_tables_bound_batches_and_leave_the_session_alone(spark):
    from alphaloom.llm.common import BATCH_BYTES, MOST_BYTES, removed, written

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["n", "r"])

    before = spark.conf.get(BATCH_BYTES)
    texts = spark.range(0, 200, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    found = written(texts.mapInArrow(sizes, "n long, r long"), "sizes")
    assert spark.conf.get(BATCH_BYTES) == before
    got = found.collect()
    assert len(got) > 1 and sum(x.r for x in got) == 200 and max(x.n for x in got) <= 2 * MOST_BYTES
    removed(found)
