"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Fixed patterns give the kinds ``assign``, ``access`` and ``hex``.  The kind
``markov`` adds other tokens of ``MIN_TOKEN`` or more characters whose
characters follow each other as in random strings rather than as in ordinary
identifiers: two first-order models are trained from labelled samples, and the
sum of the log ratios of their transition probabilities must reach ``MIN_LLR``
(a million to one).  A token that overlaps a fixed span is not reported again.

All on DataFrame functions.  Positions come from the pieces between matches.
The models hold one number for each pair of ``ALPHABET``'s characters; this
bounded table is all that reaches the driver, and it goes back as a literal.
Samples are labelled by the fixed patterns, in at most about ``SAMPLE_DOCS``
documents (a bounded sample by hash): what they find is random, the words outside
are ordinary; ``RANDOM_STRINGS`` generated strings join the former.  Samples that
are labelled otherwise can be passed to :func:`scan`.

Edge cases: a null text counts as empty; positions count code points, ends are
exclusive; repeated rows are returned each; very long texts are scanned whole;
other columns are ignored; an empty table trains on generated strings alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_LLR = math.log(1e6)
SAMPLE_DOCS = 2000
RANDOM_STRINGS = 2000
SMOOTHING = 0.5

_SPAN = "array<struct<s:int,e:int,n:int,t:string>>"


def spans(text: Column, pattern: str, value: int | None = None) -> Column:
    """Matches of a pattern: start, end, length of group ``value`` (or of the match) and the matched text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("m"), values.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), F.length(x["v"]).alias("n"), x["m"].alias("t")))).alias("out"))

    some = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(pattern)), some).otherwise(F.array().cast(_SPAN))


def labelled_samples(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``random`` (boolean) and ``token``, from a bounded sample of documents, and generated random strings.

    Random are the values that fixed patterns find, of ``MIN_TOKEN`` or more characters with a digit.
    Identifiers are words of letters, single and joined as snake_case and
    camelCase by their order in the text; words inside fixed spans are left out.
    """
    spark = docs.sparkSession
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    some = docs.where(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(1_000_003)) < int(share * 1_000_003) + (share == 1.0))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), ASSIGN, " "), r"[^\x20\n]*[0-9][^\x20\n]*", " ")
    words = some.select(F.regexp_extract_all(plain, F.lit(r"[A-Za-z]{2,}"), F.lit(0)).alias("w")).where(F.size("w") > 2)
    joined = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.when(i % 2 == 0, F.concat_ws("_", F.get("w", i), F.get("w", i + 1))).otherwise(F.concat(F.get("w", i), F.initcap(F.get("w", i + 1)), F.initcap(F.get("w", i + 2)))))
    ordinary = words.select(F.explode(F.concat("w", joined)).alias("token")).select(F.lit(False).alias("random"), "token")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    values = F.concat(F.regexp_extract_all(whole, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(whole, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(whole, F.lit(HEX), F.lit(0)))
    labelled = some.select(F.explode(values).alias("token")).where((F.length("token") >= MIN_TOKEN) & F.rlike("token", F.lit("[0-9]"))).select(F.lit(True).alias("random"), "token")
    digest = F.sha2(F.col("id").cast("string"), 512)
    made = F.array(F.substring(digest, 1, 40), F.base64(F.unhex(F.substring(digest, 1, 60))), F.translate(F.base64(F.unhex(F.substring(digest, 60, 60))), "+/", "-_"), F.upper(F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", "AZ7"), 1, 20)))
    generated = spark.range(RANDOM_STRINGS).select(F.explode(made).alias("token")).select(F.lit(True).alias("random"), "token")
    return ordinary.unionByName(labelled).unionByName(generated)


def fit(samples: DataFrame) -> list[float]:
    """Log ratio of the transition probabilities for each pair of the alphabet, row by row."""
    k = len(ALPHABET)
    code = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))
    two = samples.where(F.length("token") > 1).select("random", F.explode(pairs).alias("p")).groupBy("random", "p").count()
    coded = two.select("random", code(F.substring("p", 1, 1)).alias("a"), code(F.substring("p", 2, 1)).alias("b"), "count").where("a >= 0 and b >= 0")
    counts = {(r["random"], r["a"], r["b"]): r["count"] for r in coded.groupBy("random", "a", "b").agg(F.sum("count").alias("count")).collect()}  # at most 2 * 67 * 67 rows
    row = {(x, a): sum(counts.get((x, a, b), 0) for b in range(k)) for x in (True, False) for a in range(k)}
    log_p = lambda x, a, b: math.log((counts.get((x, a, b), 0) + SMOOTHING) / (row[x, a] + SMOOTHING * k))
    return [log_p(True, a, b) - log_p(False, a, b) for a in range(k) for b in range(k)]


def llr(token: Column, table: list[float]) -> Column:
    k = len(ALPHABET)
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    codes = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1)
    return F.transform(F.array(codes), lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.get(ratios, F.get(c, i - 1) * k + F.get(c, i))))[0]


def scan(docs: DataFrame, table: list[float] | None = None, samples: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and ``found``, an array of ``(s, e, kind)`` in order; ``kind`` is a place in ``KINDS``."""
    if table is None:
        table = fit(samples if samples is not None else labelled_samples(docs, key, text))
    d = docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    d = d.select(key, spans(F.col("__t"), ASSIGN, 2).alias("__a"), spans(F.col("__t"), ACCESS).alias("__k"), spans(F.col("__t"), HEX).alias("__h"), spans(F.col("__t"), TOKEN).alias("__m"))
    part = lambda c, kind: F.transform(c, lambda x: F.struct(x["s"], x["e"], F.lit(kind).alias("kind")))
    d = d.select(key, F.concat(part(F.filter("__a", lambda x: x["n"] >= MIN_VALUE), 0), part("__k", 1), part("__h", 2)).alias("__base"), "__m")
    more = F.filter("__m", lambda x: (llr(x["t"], table) >= MIN_LLR) & ~F.exists("__base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    order = F.array_sort(F.transform(F.concat("__base", part(more, 3)), lambda x: F.struct(x["s"], x["kind"], x["e"])))
    return d.select(key, F.transform(order, lambda x: F.struct(x["s"], x["e"], x["kind"])).alias("found"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < 3)
    return found.select(key, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def _twin(kind: int, pattern: str, value: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT doc_id, {kind} AS kind, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {value}) AS v, string_split_regex(t, '{p}') AS g FROM d"


#: SQL twin of the base columns.
BASE_ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({_twin(0, ASSIGN, 2)} UNION ALL {_twin(1, ACCESS)} UNION ALL {_twin(2, HEX)}),
s AS (SELECT doc_id, kind, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n, length(v[i]) AS l FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
f AS (SELECT doc_id, kind, (['{KINDS[0]}', '{KINDS[1]}', '{KINDS[2]}'])[kind + 1] || ':' || a || ':' || (a + n) AS w, a FROM s WHERE kind <> 0 OR l >= {MIN_VALUE})
SELECT d.doc_id, count(kind) FILTER (kind = 0) AS n_assign, count(kind) FILTER (kind = 1) AS n_access, count(kind) FILTER (kind = 2) AS n_hex, sha256(coalesce(string_agg(w, ',' ORDER BY a, kind), '')) AS base_sha256
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""
