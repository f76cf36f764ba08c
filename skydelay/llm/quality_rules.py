"""Quality rules by distribution divergence, in DataFrame functions only.

Every document is described by two histograms: its characters over seven classes, and its words over the common words of
its language plus one cell for all other words. Both are compared with the histograms of the language (summed over the
documents of the language that pass the base rules) by Jensen-Shannon distance. A document is kept if it passes the base
rules and neither distance exceeds its limit; a distance only counts from a minimum length on, as short texts stray far
from any reference by chance. Every value of ``lang`` has a reference of its own (a row per language); the word histogram
is compared in the languages whose common words are listed.

Everything about a document is computed from its own row with array functions, so no text is shuffled: repeated
three-word windows are found by sorting the document's window hashes. Only the per-document counts are written and summed
per language (partial sums first, so a language holding most rows costs no more).

Nulls are empty texts; a document of null language is compared by characters with the nearest of all languages (with the
sum of such documents if no language is given anywhere). Repeated rows are judged each on its own. An empty table gives
none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydelay.session import cut_lineage

MIN_WORDS = 50            # base rule
MAX_REPEAT_PERCENT = 50   # base rule
CHARS_FROM, WORDS_FROM = 200, 100   # shortest text (characters, words) whose distance counts
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.30

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er hat".split(),
    "en": "the of and to in a is that it for on was be with as by this at are an from or which you".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce".split(),
}
TOP = 24
# The classes other than "anything else"; spaces and symbols are those of the base columns.
CHAR_CLASSES = {
    "lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "space": "[\\x20\\x09-\\x0D]+", "symbol": "[#*$%&|<>]+",
    "punct": "[\\x21-\\x7E]+",
}
SPACES = "[\\x20\\x09-\\x0D]+"


def _repeated_words(windows: Column) -> Column:
    """Number of words covered by windows whose hash occurs at least twice. ``windows``: hash of each 3-word window."""
    def covered(ordered: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            return (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"])
        places = F.transform(F.filter(ordered, lambda x, i: F.coalesce(twice(x, i), F.lit(False))),
                             lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(windows) > F.size(F.array_distinct(windows))
    return F.when(some, F.transform(F.array(pairs), covered)[0]).otherwise(F.lit(0))


def describe(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The base columns, class counts and common-word counts of every row. Narrow: one pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    all_common = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    lists = F.lit(None).cast("array<string>")
    for lang, ws in COMMON_WORDS.items():
        lists = F.when(F.col("lang") == lang, F.array(*map(F.lit, ws))).otherwise(lists)
    # class counts: what each successive removal takes away
    rows = docs.select(*keep, "doc_id", "lang", text.alias("text"), text.alias("rest"), F.array().cast("array<int>").alias("left"))
    for pattern in CHAR_CLASSES.values():
        rows = rows.select(*keep, "doc_id", "lang", "text", F.regexp_replace("rest", pattern, "").alias("rest"),
                           F.array_append("left", F.length("rest")).alias("left"))
    left = F.array_append("left", F.length("rest"))
    chars = F.transform(left, lambda x, i: (x - F.coalesce(F.get(left, i + 1), F.lit(0))).cast("long"))
    rows = rows.select(*keep, "doc_id", "lang", chars.alias("chars"),
                       F.array_remove(F.split("text", SPACES), "").alias("words"),
                       F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    n = F.size("words")
    word = F.col("words")
    rows = rows.select(
        *keep, "doc_id", "lang", "chars", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
            F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.filter("words", lambda w: w.isin(all_common)).alias("common"), lists.alias("list"))
    own = F.transform("list", lambda w: (F.size("common") - F.size(F.array_remove("common", w))).cast("long"))
    rows = rows.select(*keep, "doc_id", "lang", "n_words", "n_dup_lines", "chars", own.alias("common_counts"),
                       _repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"))
    place = {name: i for i, name in enumerate(CHAR_CLASSES)}
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < MIN_WORDS) | \
        (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select(*keep, "doc_id", "lang", "n_words", (total - F.col("chars")[place["space"]]).alias("word_chars"),
                       F.col("chars")[place["symbol"]].alias("n_symbols"), "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), "chars", "common_counts", total.alias("n_chars_all"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two arrays of shares."""
    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _references(described: DataFrame, among: Column) -> DataFrame:
    """(ref, ref_chars, ref_words, ref_n): histograms of each language, summed over the rows ``among``."""
    return described.where(among).groupBy(_key().alias("ref")).agg(
        F.array(*[F.sum(F.get("chars", F.lit(i))) for i in range(len(CHAR_CLASSES) + 1)]).alias("ref_chars"),
        F.array(*[F.sum(F.get("common_counts", F.lit(i))) for i in range(TOP)]).alias("ref_words"),
        F.sum("n_words").alias("ref_n"))


def _key() -> Column:
    """Never equal for a null and an empty language."""
    return F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("l:"), F.col("lang")))


def _compare(described: DataFrame, references: DataFrame) -> DataFrame:
    """Adds char_distance and word_distance to the references."""
    known = F.col("common_counts").isNotNull()
    # rows of null language look at the references of all languages: one row holds them (a cell per language)
    own, languages = (F.collect_list(F.when(c, F.col("ref_chars"))) for c in (F.col("ref") == "", F.col("ref") != ""))
    nearest = references.agg(languages.alias("many"), own.alias("pool")) \
        .select(F.lit("").alias("ref"), F.when(F.size("many") > 0, F.col("many")).otherwise(F.col("pool")).alias("ref_any"))
    both = references.unionByName(nearest, allowMissingColumns=True)
    table = cut_lineage(both.groupBy("ref").agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c != "ref"]))
    with_rest = F.array_append("common_counts", F.col("n_words") - _sum(F.col("common_counts")))
    ref_rest = F.array_append("ref_words", F.col("ref_n") - _sum(F.col("ref_words")))
    rows = described.withColumn("ref", _key()).join(table, "ref", "left")
    shares = _shares(F.col("chars"), F.col("n_chars_all"))
    chars = _distance(shares, _shares(F.col("ref_chars"), _sum(F.col("ref_chars"))))
    any_chars = F.array_min(F.transform("ref_any", lambda r: _distance(shares, _shares(r, _sum(r)))))
    words = _distance(_shares(with_rest, F.col("n_words")), _shares(ref_rest, F.col("ref_n")))
    return rows.withColumn("char_distance", F.when(F.col("n_chars_all") >= CHARS_FROM,
                                                   F.when(F.col("lang").isNull(), any_chars).when(F.col("ref_n") > 0, chars))) \
        .withColumn("word_distance", F.when((F.col("n_words") >= WORDS_FROM) & (F.col("ref_n") > 0) & known, words)) \
        .drop("ref", "ref_chars", "ref_words", "ref_n", "ref_any")


def judge(described: DataFrame) -> DataFrame:
    """Adds char_distance, word_distance (null where there is no reference or too short a text) and kept.

    The first references are summed over all rows that pass the base rules, the final ones over those of them that are
    within both limits of the first, so junk that passes the base rules hardly bends what it is measured by. A language
    none of whose rows are keeps its first reference."""
    near = ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & \
        (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    all_rows = cut_lineage(_references(described, ~F.col("base_failed")))
    first = cut_lineage(_compare(described, all_rows).withColumn("near", near).drop("char_distance", "word_distance"))
    near_rows = cut_lineage(_references(first, F.col("near")))
    final = near_rows.unionByName(all_rows.join(near_rows, "ref", "left_anti"))
    return _compare(first, final).withColumn("kept", near).drop("near")


def rules(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return judge(cut_lineage(describe(docs, keep)))


def op9(docs: DataFrame) -> DataFrame:
    return rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"),
                              F.round("word_distance", 6).alias("word_distance"))


def oracle_sql() -> str:
    """The same result in DuckDB SQL over ``documents``."""
    n_classes, space = len(CHAR_CLASSES) + 1, "[\\x20\\x09-\\x0D]+"
    rest = ["text"]
    for pattern in CHAR_CLASSES.values():
        rest.append(f"regexp_replace({rest[-1]}, '{pattern}', '', 'g')")
    lengths = [f"length({r})" for r in rest] + ["0"]
    chars = ", ".join(f"{a} - {b} AS c{i}" for i, (a, b) in enumerate(zip(lengths, lengths[1:])))
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in ws)}]" for k, ws in COMMON_WORDS.items())
    own = ", ".join(f"len(list_filter(words, lambda x: x = list[{i + 1}])) AS w{i}" for i in range(TOP))
    total = " + ".join(f"c{i}" for i in range(n_classes))
    cells = [f"c{i}" for i in range(n_classes)] + [f"w{i}" for i in range(TOP)]
    sums = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS r{c}" for c in cells)

    def distance(pairs: list[tuple[str, str]]) -> str:
        half = "(CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END)"
        terms = " + ".join(half.format(x=f"({a})", y=f"({b})") + " + " + half.format(x=f"({b})", y=f"({a})") for a, b in pairs)
        return f"sqrt(greatest(({terms}) / 2, 0.0))"

    ref_total = " + ".join(f"rc{i}" for i in range(n_classes))
    by_char = distance([(f"c{i} / n_all", f"rc{i} / ref_all") for i in range(n_classes)])
    by_word = distance([(f"w{i} / n_words", f"rw{i} / ref_n") for i in range(TOP)] + [
        (f"(n_words - ({' + '.join(f'w{i}' for i in range(TOP))})) / n_words",
         f"(ref_n - ({' + '.join(f'rw{i}' for i in range(TOP))})) / ref_n")])

    def references(rows: str, among: str) -> str:
        return f"""SELECT *, {ref_total} AS ref_all FROM (
    SELECT ref, CAST(sum(n_words) AS DOUBLE) AS ref_n, {sums} FROM {rows} WHERE {among} GROUP BY ref) x"""

    def compare(rows: str, refs: str) -> str:
        return f"""SELECT s.*, CASE WHEN n_all < {CHARS_FROM} THEN NULL WHEN s.ref = '' THEN nearest WHEN ref_n > 0 THEN {by_char} END AS char_distance,
    CASE WHEN n_words >= {WORDS_FROM} AND ref_n > 0 AND list IS NOT NULL THEN {by_word} END AS word_distance
  FROM {rows} s LEFT JOIN {refs} r ON s.ref = r.ref LEFT JOIN (
    SELECT rid AS near_rid, min({by_char}) AS nearest FROM {rows} s JOIN {refs} r ON s.ref = '' AND n_all >= {CHARS_FROM}
      AND (r.ref <> '' OR NOT EXISTS (SELECT 1 FROM {refs} WHERE ref <> '')) GROUP BY rid) y ON near_rid = rid"""

    near = f"(NOT base_failed AND COALESCE(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND COALESCE(word_distance, 0) <= {MAX_WORD_DISTANCE})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, COALESCE(text, '') AS text FROM documents),
t AS (SELECT rid, doc_id, lang, {chars}, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, CASE lang {lists} END AS list FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (
  SELECT rid, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM t) x),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) x WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
s0 AS (SELECT rid, doc_id, list, CASE WHEN lang IS NULL THEN '' ELSE 'l:' || lang END AS ref, len(words) AS n_words, {total} AS n_all,
  {", ".join(f"c{i}" for i in range(n_classes))}, {own}, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  COALESCE(n_repeat, 0) AS n_repeat_words FROM t LEFT JOIN cov USING (rid)),
s1 AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s0),
r1 AS ({references("s1", "NOT base_failed")}),
f AS ({compare("s1", "r1")}),
s2 AS (SELECT * EXCLUDE (char_distance, word_distance), {near} AS near FROM f),
r2 AS ({references("s2", "near")}),
r3 AS (SELECT * FROM r2 UNION ALL SELECT * FROM r1 WHERE ref NOT IN (SELECT ref FROM r2)),
g AS ({compare("s2", "r3")})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_all - c{list(CHAR_CLASSES).index("space")} AS BIGINT) AS word_chars,
  CAST(c{list(CHAR_CLASSES).index("symbol")} AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, {near} AS kept, round(char_distance, 6) AS char_distance,
  round(word_distance, 6) AS word_distance FROM g"""


def filtered(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The ``columns`` of the rows that are kept. The texts are not written along with the counts: rows are numbered as
    read, and only the numbers of the kept rows come back."""
    numbered = docs.select(*columns, F.monotonically_increasing_id().alias("row_no"))
    kept = cut_lineage(rules(numbered, ("row_no",)).where("kept").select("row_no"))
    # a sort-merge join at every size: the rows that stay are no bounded table
    return numbered.join(kept.hint("merge"), "row_no", "left_semi").select(*columns)
