"""Line dedup by a tree of line templates, in DataFrame operations only.

The tree has a fixed depth: the number of tokens of a line, then its first tokens, where a token with a digit is a
variable field; a line of no more tokens than that has a leaf of its own. In a leaf, lines that share their most frequent
further word are alike enough to be judged together. Of each line, the words that are most frequent among these lines
are its constants, and in a second reading those at the places with the fewest different words; as many as make up the
least share of constants. Lines with equal constants are one template, the rest of them are variable fields, whatever
else stands in the leaf and however much. A line takes the reading that more documents share; a line without companions
stands for itself. Templates that enough documents share are dropped everywhere but in the document with the smallest
doc_id, so shared text stays once.

Only leaves and words that enough documents share are looked into, and only distinct lines are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.llm.common import SPACES, WORD, fresh, stored

#: Leading tokens that lead to a leaf.
DEPTH = 3
#: Documents that make a word known in a leaf, and a template recurring.
MIN_DOCS = 5
#: Least share of constant tokens in a template, and again of constants among the words behind the leaf's tokens: these are
#: alike in all of the leaf, and would make short lines with rare endings alike.
MIN_CONSTANT = 0.6
FIELD = "<*>"


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, doc, at, line, n, leaf) for lines with a token; doc is the same for repeated rows only."""
    value = docs[text].cast("string")
    lines = docs.select(
        F.col("doc_id"), F.xxhash64("doc_id", value).alias("doc"), F.posexplode(F.split(value, "\n")).alias("at", "line")
    )
    # Most lines have single spaces between tokens only; they are counted and cut without regular expressions.
    line = F.col("line")
    odd = line.startswith(" ") | line.endswith(" ")
    for gap in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | line.contains(gap)
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    n = F.when(odd, F.regexp_count(line, F.lit(WORD))).otherwise(spaces + 1)
    lines = lines.filter(line != "").withColumn("n", n).filter(F.col("n") > 0)
    first = F.regexp_extract(line, rf"^[{SPACES}]*({WORD}(?:[{SPACES}]+{WORD}){{0,{DEPTH - 1}}})", 1)
    first = F.when(odd, F.regexp_replace(first, rf"[{SPACES}]+", " ")).otherwise(F.substring_index(line, " ", DEPTH))
    masked = F.when(first.rlike("[0-9]"), F.regexp_replace(first, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(first)
    return lines.withColumn("leaf", F.xxhash64("n", masked))


def _key(words: Column, order: str) -> Column:
    """The constants of a line: the first `need` of its words in this order, and the lines they are judged among."""
    ordered = F.sort_array(F.transform(words, lambda x: F.struct(x[order].alias("o"), x["place"].alias("place"), x["token"].alias("token"))))
    chosen = F.transform(F.slice(ordered, F.lit(1), F.col("need")), lambda x: F.struct(x["place"].alias("place"), x["token"].alias("token")))
    return F.xxhash64("near", F.sort_array(chosen))


def templates(distinct: DataFrame) -> DataFrame:
    """(leaf, own, template) of the distinct lines (leaf, own, docs, line, n) that may recur."""
    tokens = F.transform(
        F.regexp_extract_all("line", F.lit(WORD), F.lit(0)),
        lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t),
    )
    lines = distinct.select("leaf", "own", "docs", "n", tokens.alias("tokens"))
    is_word = lambda t: t != FIELD
    words = F.size(F.filter(F.slice("tokens", DEPTH + 1, F.greatest(F.col("n"), F.lit(1))), is_word))
    ahead = F.size(F.filter(F.slice("tokens", 1, DEPTH), is_word))
    least = lambda x: F.ceil(x * MIN_CONSTANT - 1e-9).cast("int")
    lines = lines.withColumn("words", words).withColumn("need", F.greatest(least(F.col("words")), least(F.col("n")) - ahead))

    each = lines.filter((F.col("words") > 0) & (F.col("need") <= F.col("words")))
    each = each.select("leaf", "own", "docs", "need", F.posexplode("tokens").alias("place", "token"))
    each = each.filter((F.col("place") >= DEPTH) & (F.col("token") != FIELD))
    support = each.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support")).filter(F.col("support") >= MIN_DOCS)
    best = F.min(F.struct((-F.col("support")).alias("support"), "place", "token")).alias("best")
    known = each.join(support, ["leaf", "place", "token"]).groupBy("leaf", "own", "docs", "need")
    known = known.agg(best, F.collect_list(F.struct("place", "token")).alias("known")).filter(F.size("known") >= F.col("need"))
    near = F.xxhash64("leaf", "best.place", "best.token").alias("near")
    each = known.select("leaf", "own", "docs", "need", near, F.inline("known"))

    frequent = each.groupBy("near", "place", "token").agg((-F.sum("docs")).alias("frequent"))
    different = frequent.groupBy("near", "place").agg(F.count("*").alias("different"))
    frequent = frequent.join(different, ["near", "place"])
    found = each.join(frequent, ["near", "place", "token"]).groupBy("leaf", "own", "docs", "need", "near")
    found = found.agg(F.collect_list(F.struct("frequent", "different", "place", "token")).alias("words"))
    keys = F.array_distinct(F.array(_key(F.col("words"), "frequent"), _key(F.col("words"), "different")))
    found = found.select("leaf", "own", "docs", F.posexplode(keys).alias("reading", "key"))
    shared = found.groupBy("key").agg((-F.sum("docs")).alias("shared")).filter(F.col("shared") <= -MIN_DOCS)
    chosen = found.join(shared, "key").groupBy("leaf", "own").agg(F.min(F.struct("shared", "reading", "key")).alias("chosen"))

    out = lines.join(chosen.select("leaf", "own", F.col("chosen.key").alias("key")), ["leaf", "own"], "left")
    numbers = (F.col("words") == 0) & (F.col("need") <= 0)
    alone = F.when(F.col("docs") >= MIN_DOCS, F.xxhash64("leaf", "own", F.lit(0)))
    template = F.when(numbers, F.xxhash64("leaf", F.lit(1))).otherwise(F.coalesce("key", alone))
    return out.select("leaf", "own", template.alias("template")).filter(F.col("template").isNotNull())


def recurring(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, dropped): for each document that loses lines, their places from 0."""
    lines = _lines(docs, text)
    leaves = lines.select("leaf", "doc").distinct().groupBy("leaf").count().filter(F.col("count") >= MIN_DOCS)
    leaves = stored(leaves.select("leaf"), "leaves")  # a plain table, so that a join with a heavy leaf can be split
    held = lines.join(leaves, "leaf").withColumn("own", F.xxhash64("line"))
    held = stored(held.select("leaf", "own", "line", "n", "doc_id", "doc", "at"), "lines")
    distinct = held.groupBy("leaf", "own", "doc").agg(F.min("line").alias("line"), F.min("n").alias("n"))
    distinct = distinct.groupBy("leaf", "own").agg(
        F.count("*").alias("docs"), F.min("line").alias("line"), F.min("n").alias("n")
    )
    found = stored(templates(stored(distinct, "distinct-lines")), "line-templates")
    held = held.drop("line", "n").join(found, ["leaf", "own"])
    held = stored(held.select("template", "doc_id", "doc", "at"), "templated-lines")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("doc"))).alias("first")
    per_doc = held.groupBy("template", "doc").agg(F.min("doc_id").alias("doc_id"))
    shared = per_doc.groupBy("template").agg(F.count("*").alias("docs"), first).filter(F.col("docs") >= MIN_DOCS)
    shared = stored(shared.select("template", F.col("first.doc").alias("first")), "templates")  # as the leaves
    again = held.join(shared, "template")
    again = again.filter(F.col("doc") != F.col("first"))
    return again.groupBy("doc").agg(F.collect_set("at").alias("dropped"))


def drop_templates(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the text less its recurring lines, and the names of two further columns: all lines, dropped lines.

    A null text stays null and has no lines; an empty text has one line. A text may lose all lines and become empty; its
    row stays. Equal rows count as one document and lose the same lines. Rows with a null doc_id are documents of their
    own by text, and come after all others when the first document of a template is chosen. Lines equal but for white
    space between tokens have one template. No text is compared across documents beyond the lines of shared leaves.
    """
    n, gone, doc = (fresh(docs, f"template_{x}") for x in ("lines", "dropped", "doc"))
    value = docs[text].cast("string")
    dropped = recurring(docs, text).select(F.col("doc").alias(doc), F.col("dropped").alias(gone))
    out = docs.withColumn(f"{doc}_own", F.xxhash64("doc_id", value))
    out = out.join(dropped, out[f"{doc}_own"] == dropped[doc], "left").drop(doc, f"{doc}_own")
    parts = F.split(F.col(text).cast("string"), "\n")
    left = F.filter(parts, lambda line, i: ~F.array_contains(F.col(gone), i))
    kept = F.when(F.col(gone).isNull(), F.col(text).cast("string")).otherwise(F.concat_ws("\n", left))
    return out.select(
        *(kept.alias(c) if c == text else F.col(c) for c in docs.columns),
        F.greatest(F.coalesce(F.size(parts), F.lit(0)), F.lit(0)).cast("long").alias(n),
        F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("long").alias(gone),
    ), n, gone


ORACLE_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS at
  FROM documents WHERE text IS NOT NULL
), numbered AS (
  SELECT *, len(tokens) AS n, tokens[1:{DEPTH}] AS head FROM (
    SELECT *, list_transform(regexp_extract_all(line, '{WORD}'),
      lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS tokens
    FROM lines) WHERE len(tokens) > 0
), leaves AS (
  SELECT row_number() OVER () AS leaf, n, head FROM numbered GROUP BY n, head HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), held AS (
  SELECT numbered.*, leaf FROM numbered JOIN leaves USING (n, head)
), own AS MATERIALIZED (
  SELECT *, greatest(CAST(ceil(words * {MIN_CONSTANT} - 1e-9) AS INT), CAST(ceil(n * {MIN_CONSTANT} - 1e-9) AS INT) - ahead) AS need
  FROM (
    SELECT row_number() OVER () AS own, leaf, line, any_value(n) AS n, any_value(tokens) AS tokens, count(DISTINCT doc_id) AS docs,
      len(list_filter(any_value(tokens)[{DEPTH + 1}:], lambda t: t <> '{FIELD}')) AS words,
      len(list_filter(any_value(tokens)[1:{DEPTH}], lambda t: t <> '{FIELD}')) AS ahead
    FROM held GROUP BY leaf, line)
), each AS (
  SELECT * FROM (
    SELECT leaf, own, docs, need, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place
    FROM own WHERE words > 0 AND need <= words)
  WHERE place > {DEPTH} AND token <> '{FIELD}'
), support AS (
  SELECT leaf, place, token, sum(docs) AS support FROM each GROUP BY leaf, place, token HAVING sum(docs) >= {MIN_DOCS}
), known AS (
  SELECT each.*, support FROM each JOIN support USING (leaf, place, token)
), best AS (
  SELECT own, arg_min(place, (-support, place)) AS best_place, arg_min(token, (-support, place)) AS best_token
  FROM known GROUP BY own, need HAVING count(*) >= need
), near AS MATERIALIZED (
  SELECT known.leaf, own, docs, need, place, token, dense_rank() OVER (ORDER BY known.leaf, best_place, best_token) AS near
  FROM known JOIN best USING (own)
), frequent AS (
  SELECT *, count(*) OVER (PARTITION BY near, place) AS different FROM (
    SELECT near, place, token, sum(docs) AS frequent FROM near GROUP BY near, place, token)
), ranked AS (
  SELECT near.*, row_number() OVER (PARTITION BY own ORDER BY frequent DESC, place) AS by_frequent,
    row_number() OVER (PARTITION BY own ORDER BY different, place) AS by_different
  FROM near JOIN frequent USING (near, place, token)
), readings AS (
  SELECT own, any_value(docs) AS docs, 0 AS reading, near, list((place, token) ORDER BY place) AS key
  FROM ranked WHERE by_frequent <= need GROUP BY own, near
  UNION ALL
  SELECT own, any_value(docs), 1, near, list((place, token) ORDER BY place)
  FROM ranked WHERE by_different <= need GROUP BY own, near
), distinct_readings AS MATERIALIZED (
  SELECT own, any_value(docs) AS docs, min(reading) AS reading, near, key FROM readings GROUP BY own, near, key
), shared_keys AS (
  SELECT row_number() OVER () AS id, near, key, sum(docs) AS shared FROM distinct_readings GROUP BY near, key HAVING sum(docs) >= {MIN_DOCS}
), chosen AS (
  SELECT own, arg_min(id, (-shared, reading)) AS id FROM distinct_readings JOIN shared_keys USING (near, key) GROUP BY own
), templated AS (
  SELECT h.doc_id, h.at, o.leaf, CASE WHEN words = 0 AND need <= 0 THEN 'numbers' WHEN id IS NOT NULL THEN 'shared' ELSE 'alone' END AS kind,
    CASE WHEN words = 0 AND need <= 0 THEN 0 WHEN id IS NOT NULL THEN id ELSE own END AS template
  FROM held h JOIN own o ON h.leaf = o.leaf AND h.line = o.line LEFT JOIN chosen USING (own)
), shared AS (
  SELECT leaf, kind, template, min(doc_id) AS first FROM templated
  GROUP BY leaf, kind, template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), dropped AS (
  SELECT DISTINCT t.doc_id, t.at FROM templated t JOIN shared s USING (leaf, kind, template) WHERE t.doc_id <> s.first
), joined AS (
  SELECT l.doc_id, count(*) AS n_lines, count(d.at) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.at) FILTER (WHERE d.at IS NULL), '') AS kept
  FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.at = d.at GROUP BY l.doc_id
)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
  md5(kept) AS kept_md5
FROM documents LEFT JOIN joined USING (doc_id)
"""
