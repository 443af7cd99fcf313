"""Secret scan: fixed patterns, and character Markov models of random strings and of ordinary identifiers compared by log-likelihood ratio."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import bound, prefixes, sample_rate, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Equal to [0-9a-f]+ of 24 characters or more: a match is always a whole run.
HEX = r"[0-9a-f]{24,}"
#: Runs that the models judge: of RUN_CHARACTERS and at least LEAST_RUN of them, which is where a ratio can reach THRESHOLD at all (under one nat a character on average).
RUN_CHARACTERS, LEAST_RUN = "A-Za-z0-9+/_=-", 16
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Letters of ALPHABET, and 0 for any other character.
STATES = len(ALPHABET) + 1
#: A candidate is a secret if its log-likelihood ratio, random to ordinary, is above this (nats): odds of over 160,000 to 1.
THRESHOLD = 12.0
#: Different characters that a run has at least: rows and short patterns of the same letters are no secrets, however unlike identifiers.
LEAST_DISTINCT = 8
#: Documents from which labelled samples are taken, on average at most: the bound of the training set.
TRAINING_DOCS = 4000
#: Numbers whose hashes serve as random strings, and how often each identifier counts.
RANDOM_NUMBERS, IDENTIFIER_WEIGHT = 3000, 20
#: Ordinary identifiers of code, which prose lacks.
IDENTIFIERS = """
getElementById addEventListener create_temporary_view spark_session_builder max_partition_bytes parse_command_line_arguments initializeComponent
calculate_total_amount user_account_settings HttpRequestHandler AbstractFactoryBean response_status_code default_configuration_path isAuthenticatedUser
test_integration_suite ConcurrentHashMap serialize_to_json string_builder_append DatabaseConnectionPool environment_variables MAX_RETRY_COUNT DEFAULT_TIMEOUT_SECONDS
load_balancer_config internal/server/handlers/middleware src/main/resources/application usr/local/share/applications include/linux/netdevice
content-security-policy access-control-allow-origin application/x-www-form-urlencoded background-color-transition number_of_iterations learning_rate_schedule
transformer_encoder_layer validation_accuracy customer_order_line_item shipping_address_second_line org/apache/commons/lang documentation/getting-started
""".split()


SPAN = "struct<start:long,kind:int,end:long,word:string,size:long>"


def spans(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0) -> Column:
    """The leftmost non-overlapping matches, as array<SPAN> in code points (kind: its rank); those whose group has under least characters are left out.

    Positions are prefix sums over the gaps that split() leaves and the matches that regexp_extract_all() finds, which the same matcher walks in the same order.
    """
    long = lambda c: F.length(c).cast("long")
    none = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), long) if group else F.transform(found, long)
    pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("word"), sizes.alias("size"))

    def placed(p: Column) -> Column:
        lengths = F.transform(p, lambda x: long(x["gap"]) + long(x["word"]))
        begin = prefixes(lengths, F.lit(0).cast("long"), lambda x, y: x + y)

        def one(x: Column, before: Column) -> Column:
            start = before + long(x["gap"])
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + long(x["word"])).alias("end"), x["word"].alias("word"), x["size"].alias("size"))

        return F.filter(F.zip_with(p, begin, one), lambda x: x["size"] >= least)

    return F.when(text.rlike(pattern), bound(pieces, placed)).otherwise(none).cast(f"array<{SPAN}>")


def base_spans(docs: DataFrame) -> DataFrame:
    """row (the input's columns, as one struct, so that no name can clash), t (the text; null: empty), assign, access and hex (spans of each kind)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("t", F.coalesce("row.text", F.lit("")))
    t = F.col("t")
    return rows.withColumns({"assign": spans(t, ASSIGN, "assign", 6, 2), "access": spans(t, ACCESS, "access", 20), "hex": spans(t, HEX, "hex", 24)})


def _tokens(words: Column) -> Column:
    return F.explode(words).alias("word")


def labelled_samples(docs: DataFrame) -> DataFrame:
    """word, secret: matches of the fixed patterns in a bounded sample of documents and hashes of numbers are secrets; the other words of those documents and
    code identifiers are ordinary. TRAINING_DOCS bounds the sample; the ids decide who is in it."""
    spark = docs.sparkSession
    n = docs.select("doc_id").count()
    some = base_spans(docs.filter(sample_rate(F.col("doc_id"), min(1.0, TRAINING_DOCS / max(n, 1)), "secrets")).select("doc_id", "text"))
    value = lambda x: F.regexp_extract(x["word"], r"[A-Za-z0-9+/_=-]+$", 0)
    secret = some.select(_tokens(F.transform(F.concat("assign", "access", "hex"), value)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = some.select(_tokens(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))))
    hashed = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    base64 = lambda salt: F.base64(F.unhex(hashed(salt)))
    letters = F.upper(F.substring(F.regexp_replace(base64("b"), "[+/=]", ""), 1, 20))
    random = spark.range(RANDOM_NUMBERS).select(_tokens(F.array(F.substring(base64(""), 1, 40), F.substring(hashed(""), 1, 32), letters)))
    code = spark.createDataFrame([(w,) for w in IDENTIFIERS for _ in range(IDENTIFIER_WEIGHT)], "word string")
    label = lambda df, secret: df.select("word", F.lit(secret).alias("secret"))
    return label(secret, True).unionAll(label(random, True)).unionAll(label(ordinary, False)).unionAll(label(code, False))


def _states(word: Column) -> Column:
    return F.transform(F.split(word, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))


def train(samples: DataFrame) -> list[float]:
    """The table of log-likelihood ratios of transitions, row by row of the first state: at most 2 x STATES^2 counts reach the driver."""
    pairs = samples.filter(F.length("word") > 1).select("secret", _states(F.col("word")).alias("s"))
    pairs = pairs.select("secret", F.explode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", F.lit(2), F.size("s") - 1).alias("b"))).alias("p"))
    counts = {(r.secret, r.a, r.b): r.n for r in pairs.groupBy("secret", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def log_p(secret: bool) -> list[float]:
        out = []
        for a in range(STATES):
            row = [counts.get((secret, a, b), 0) + 0.5 for b in range(STATES)]
            out += [math.log(x / sum(row)) for x in row]
        return out

    return [round(x - y, 6) for x, y in zip(log_p(True), log_p(False), strict=True)]


def likelihood_ratio(word: Column, ratios: Iterable[float]) -> Column:
    """Of the random to the ordinary model, in nats; 0 for under two characters."""
    ratio = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folds to one literal
    state = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(s: Column, now: Column) -> Column:
        more = F.when(s["last"] < 0, F.lit(0.0)).otherwise(F.get(ratio, s["last"] * STATES + now))
        return F.struct(now.alias("last"), (s["sum"] + more).alias("sum"))

    return F.aggregate(_states(word), state, step)["sum"]


def find_secrets(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """row, t, assign, access and hex as of base_spans(), base and every: array<SPAN> by start and kind.

    A run of at least LEAST_RUN RUN_CHARACTERS with a letter and LEAST_DISTINCT different ones whose ratio is above THRESHOLD adds a span unless it overlaps one of the
    fixed patterns. A null or empty text has no spans; repeated rows and null ids each keep their row; an empty table gives no rows. Work grows with the matches of a text,
    not with their square.
    """
    rows = base_spans(docs)
    run = f"[{RUN_CHARACTERS}]{{{LEAST_RUN},}}"
    judged = F.filter(spans(F.col("t"), run, "markov", LEAST_RUN), lambda x: x["word"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(x["word"], ""))) >= LEAST_DISTINCT))
    judged = bound(judged, lambda runs: F.filter(runs, lambda x: likelihood_ratio(x["word"], ratios) > THRESHOLD))
    rows = rows.withColumns({"base": F.array_sort(F.concat("assign", "access", "hex")), "random": judged})
    markov, first, never = KINDS.index("markov"), F.lit(0).cast("long"), F.lit(1 << 62)

    def apart(all_: Column) -> Column:
        ends = F.transform(all_, lambda x: F.when(x["kind"] < markov, x["end"]).otherwise(first))
        starts = F.reverse(F.transform(all_, lambda x: F.when(x["kind"] < markov, x["start"]).otherwise(never)))
        before = prefixes(ends, first, lambda x, y: F.greatest(x, y))  # where the fixed patterns so far end
        after = prefixes(starts, never, lambda x, y: F.least(x, y))  # where the next begins
        with_both = F.zip_with(all_, F.zip_with(before, F.reverse(after), lambda b, a: F.struct(b.alias("b"), a.alias("a"))), lambda x, o: F.struct(x.alias("x"), o.alias("o")))
        return F.transform(F.filter(with_both, lambda p: (p["x"]["kind"] < markov) | ((p["o"]["b"] <= p["x"]["start"]) & (p["o"]["a"] >= p["x"]["end"]))), lambda p: p["x"])

    return rows.withColumn("every", F.when(F.size("random") == 0, F.col("base")).when(F.size("base") == 0, F.col("random")).otherwise(bound(F.array_sort(F.concat("base", "random")), apart)))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """A row per document with doc_id, n_assign, n_access, n_hex, n_markov, base_sha256 and spans; see find_secrets()."""
    rows = find_secrets(docs.select("doc_id", "text"), ratios)
    return rows.select(
        "row.doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        (F.size("every") - F.size("base")).cast("long").alias("n_markov"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("every")).alias("spans"),
    )


MASK = "[SECRET]"
#: Characters of the parts in which a text is copied around its spans: a place in a part is found by walking the part, not the text.
PART = 4096


def masked(text: Column, found: Column) -> Column:
    """text with found, array<SPAN> by start, overlapping ones together, replaced by MASK. Parts of the text between spans are joined once."""

    def between(parts: Column, a: Column, b: Column) -> Column:
        """Characters a to b."""
        one = lambda i: F.substring(F.get(parts, i), F.when(i == a_part, (a % PART + 1).cast("int")).otherwise(F.lit(1)), F.when(i == b_part, (b - b_part.cast("long") * PART - F.when(i == a_part, a % PART).otherwise(F.lit(0))).cast("int")).otherwise(F.lit(PART)))
        a_part, b_part = F.floor(a / PART).cast("int"), F.floor(F.greatest(b - 1, a) / PART).cast("int")
        return F.when(b > a, F.array_join(F.transform(F.sequence(a_part, b_part), one), "")).otherwise(F.lit(""))

    def joined(parts: Column) -> Column:
        ends = F.concat(F.transform(found, lambda x: x["end"]), F.array(F.length(text).cast("long")))
        before = prefixes(ends, F.lit(0).cast("long"), lambda x, y: F.greatest(x, y))
        starts = F.concat(F.transform(found, lambda x: x["start"]), F.array(F.length(text).cast("long")))
        pieces = F.zip_with(starts, before, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
        last = F.size(found)
        out = F.transform(pieces, lambda p, i: F.when(p["s"] >= p["e"], F.concat(between(parts, p["e"], p["s"]), F.when(i < last, F.lit(MASK)).otherwise(F.lit("")))).otherwise(F.lit("")))
        return F.array_join(out, "")

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), joined)


def redact(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """The documents with each span, overlapping ones together, replaced by MASK and n_chars, where there is such a column, by the new length.

    Documents without a span, null and empty texts included, stay as they are; every row, repeated ones too, stays with all its columns, whatever their names; an empty
    table gives no rows.
    """
    rows = find_secrets(docs, ratios).select("row", F.when(F.size("every") > 0, masked(F.col("t"), F.col("every"))).alias("new"))
    column = {c: F.col("row").getField(c) for c in docs.columns}
    column["text"] = F.coalesce("new", column["text"])
    if "n_chars" in column:
        column["n_chars"] = F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType), column["n_chars"])
    return rows.select(*(column[c].alias(c) for c in docs.columns))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, train(labelled_samples(docs)))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    assign, access, hexes = map(quote, (ASSIGN, ACCESS, HEX))
    run = quote(f"[{RUN_CHARACTERS}]{{{LEAST_RUN},}}")

    def found(kind: str, pattern: str, group: int, least: int) -> str:
        """Matches of a kind: the pieces between them and the matches themselves, side by side."""
        pieces = f"SELECT doc_id, t, unnest(range(len(regexp_extract_all(t, {pattern})))) AS i, unnest(regexp_extract_all(t, {pattern})) AS w, unnest(regexp_extract_all(t, {pattern}, {group})) AS g, unnest(regexp_split_to_array(t, {pattern})[:-2]) AS gap FROM docs WHERE regexp_matches(t, {pattern})"
        ends = f"SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM ({pieces})"
        return f"SELECT doc_id, {KINDS.index(kind)} AS k, e - length(w) AS s, e, w FROM ({ends}) WHERE length(g) >= {least}"

    sampled = f"('0x' || md5('secrets|' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE < 4294967296.0::DOUBLE * least(1.0::DOUBLE, {TRAINING_DOCS}.0::DOUBLE / (SELECT greatest(count(*), 1) FROM documents))"
    b64 = lambda salt: f"to_base64(unhex(sha256(i::VARCHAR || '{salt}')))"
    listed_ = lambda where: f"coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, k){where}, '')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({found("assign", assign, 2, 6)} UNION ALL {found("access", access, 0, 20)} UNION ALL {found("hex", hexes, 0, 24)}),
part AS (SELECT doc_id, t FROM docs WHERE {sampled}),
samples AS (
  SELECT regexp_extract(w, '[A-Za-z0-9+/_=-]+$') AS w, true AS secret FROM base SEMI JOIN part USING (doc_id)
  UNION ALL SELECT unnest([{b64("")}[1:40], sha256(i::VARCHAR)[1:32], upper(regexp_replace({b64("b")}, '[+/=]', '', 'g')[1:20])]), true FROM range({RANDOM_NUMBERS}) r(i)
  UNION ALL SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, {assign}, ' ', 'g'), {access}, ' ', 'g'), {hexes}, ' ', 'g'), '[A-Za-z0-9+/_=-]{{6,}}')), false FROM part
  UNION ALL SELECT unnest({IDENTIFIERS}), false FROM range({IDENTIFIER_WEIGHT})),
counts AS (SELECT secret, strpos({quote(ALPHABET)}, w[i]) AS a, strpos({quote(ALPHABET)}, w[i + 1]) AS b, count(*) AS n FROM (SELECT secret, w, unnest(range(1, length(w))) AS i FROM samples WHERE length(w) > 1) GROUP BY ALL),
smooth AS (SELECT secret, a, b, coalesce(n, 0) + 0.5::DOUBLE AS n FROM (SELECT unnest([true, false]) AS secret) CROSS JOIN range({STATES}) x(a) CROSS JOIN range({STATES}) y(b) LEFT JOIN counts USING (secret, a, b)),
logs AS (SELECT secret, a, b, ln(n / sum(n) OVER (PARTITION BY secret, a)) AS p FROM smooth),
ratios AS (SELECT x.a, x.b, round(x.p - y.p, 6) AS r FROM logs x JOIN logs y ON x.a = y.a AND x.b = y.b WHERE x.secret AND NOT y.secret),
runs AS (SELECT *, row_number() OVER () AS id FROM ({found("markov", run, 0, LEAST_RUN)}) WHERE regexp_matches(w, '[A-Za-z]') AND len(list_distinct(string_split(w, ''))) >= {LEAST_DISTINCT}),
steps AS (SELECT id, strpos({quote(ALPHABET)}, w[i]) AS a, strpos({quote(ALPHABET)}, w[i + 1]) AS b FROM (SELECT id, w, unnest(range(1, length(w))) AS i FROM runs)),
judged AS (SELECT id FROM steps JOIN ratios USING (a, b) GROUP BY id HAVING sum(r) > {THRESHOLD}),
every AS (SELECT doc_id, k, s, e FROM base UNION ALL
  SELECT doc_id, k, s, e FROM runs SEMI JOIN judged USING (id) WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = runs.doc_id AND base.s < runs.e AND runs.s < base.e))
SELECT doc_id, {", ".join(f"count(*) FILTER (k = {k})::BIGINT AS n_{n}" for k, n in enumerate(KINDS))}, sha256({listed_(" FILTER (k < 3)")}) AS base_sha256, {listed_("")} AS spans
FROM docs LEFT JOIN (SELECT *, {list(KINDS)}[k + 1] AS name FROM every) USING (doc_id) GROUP BY doc_id"""


ORACLE_SQL = _oracle()
