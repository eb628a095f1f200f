"""The operators' registered queries and their DuckDB equivalents."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from kartlens.llm import (
    bpe,
    chat_format,
    decontaminate,
    license_scan,
    lm_mixing,
    merkle,
    minhash,
    pii,
    ranked_search,
    simhash,
    source_mix,
    token_counts,
    toxicity,
)
from kartlens.llm.common import held_out, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    counted = token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_mixing.scores(docs.withColumn("held_out", held_out(F.col("doc_id"), 1)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), ngram=3, max_bits=3)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    made = source_mix.copies(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, and of one whose texts are
    control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string"
    )
    return chat_format.digests(chat_format.segments(rows.unionByName(extra)))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = minhash.with_next(
        docs, ["text", "fingerprint"], lambda rows: minhash.fingerprinted(rows, "text", "fingerprint")
    )
    pairs = pairs.select("doc_id", "text", "fingerprint", "next_fingerprint", minhash.edited(F.col("text"), F.col("next_text")).alias("edited"))
    both = minhash.fingerprinted(pairs, "edited", "edited_fingerprint")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        minhash.similarity(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        minhash.similarity(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, sf_dir, "documents")
    found = pii.spans(docs.select("doc_id", "text"), pii.fit(docs))
    base = F.filter("__spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("base"), lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long")

    return found.select("doc_id", "__spans", base.alias("base")).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("__spans")).alias("spans"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learned from labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 0))
    return toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; nothing is predicted toxic if no
    label could be learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, docs, sf_dir)
    out = toxicity.scored(docs, model)
    toxic = (F.col("__score") >= 0.5) & F.lit(toxicity.learned(model))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id"), 0).alias("held_out"),
        F.col("__score").alias("score"),
        F.when(toxic, 1).otherwise(0).alias("predicted"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, and its check against texts of which
    a fifth was put into lower case."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    changed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    found = merkle.manifest(docs, carry={"altered": F.when(changed, merkle.leaf_hash(*fields, lowered))})
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.siblings_hash(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_token_counts,
        op2_lm_mixing,
        op3_simhash,
        op4_source_mix,
        op5_chat_format,
        op6_minhash,
        op7_decontaminate,
        op8_pii,
        op9_license_scan,
        op10_toxicity,
        op11_merkle,
        op12_ranked_search,
        op13_bpe,
    )
    return {f.__name__: f for f in made}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
),
levels AS (
  SELECT *,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
           / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level,
         source_size / weight AS cap_order
  FROM per
  WINDOW before AS (ORDER BY source_size / weight, weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
common AS (
  SELECT level FROM levels WHERE NOT level * weight > 3 * source_size
  ORDER BY cap_order, weight, source NULLS LAST LIMIT 1
),
targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM common) * weight) AS target,
         CAST(('0x' || substr(md5(coalesce('mix:' || source, 'mix')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM per
),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(floor(place * rate + u) - floor((place - 1) * rate + u) AS BIGINT) * size AS taken
FROM ranked
"""

# The template's marks around a turn, in characters; a role without marks of
# its own stands escaped between other marks.
OP5_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
turns AS (
  SELECT *, length(regexp_replace(text, '([<\\[\\\\])', 'x\\1', 'g'))
            + CASE role WHEN 'system' THEN length('<s><<SYS>><</SYS>>') WHEN 'user' THEN length('<s>[INST][/INST]')
                        WHEN 'assistant' THEN length('<s>[ANS][/ANS]</s>')
                        ELSE length('<s>[ROLE][/ROLE][/END]') + length(regexp_replace(role, '([<\\[\\\\])', 'x\\1', 'g')) END AS chars,
         CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS mark
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(mark, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)*u?') AS valid
FROM turns GROUP BY conv_id
"""

OP7_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
wide AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM wide)
),
docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, n, item FROM grams JOIN windows USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
          FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs over ``leaves`` (g, pos, node): ``{name}_levels``, ``{name}_top``
    (g, top) and ``{name}_way`` (g, pos, steps), the siblings "left|right" of
    each leaf's way up."""
    return f"""
{name}_levels AS (
  SELECT g, 0 AS k, pos, node FROM {leaves}
  UNION ALL
  SELECT g, k + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}_levels) WHERE n > 1 GROUP BY g, k, pos // 16
),
{name}_top AS (SELECT g, arg_max(node, k) AS top, max(k) AS depth FROM {name}_levels GROUP BY g),
{name}_sides AS (
  SELECT l.g, l.k, l.pos,
         coalesce(string_agg(node, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' ||
         coalesce(string_agg(node, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
  FROM {name}_levels l JOIN {name}_top t ON l.g IS NOT DISTINCT FROM t.g AND l.k < t.depth
  WINDOW w AS (PARTITION BY l.g, l.k, l.pos // 16 ORDER BY l.pos)
),
{name}_way AS (
  SELECT l.g, l.pos, coalesce(list(s.step ORDER BY s.k) FILTER (s.step IS NOT NULL), []) AS steps
  FROM {leaves} l LEFT JOIN {name}_sides s
    ON l.g IS NOT DISTINCT FROM s.g AND s.pos = l.pos // CAST(pow(16, s.k) AS BIGINT)
  GROUP BY l.g, l.pos
)"""


def _marked(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_FIELDS = " || ".join(_marked(c) for c in ("doc_id", "source", "lang", "n_chars"))
# Unsigned crc32 of the decimal id, byte by byte over its table.
_CRC = """xor(4294967295, list_reduce(
  list_prepend(4294967295, list_transform(range(1, len(coalesce(CAST(doc_id AS VARCHAR), '')) + 1),
    lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
  lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)))"""

OP11_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, zero: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(0, 256)) AS n)
),
hashed AS (
  SELECT doc_id, source, sha256({_FIELDS} || {_marked('text')}) AS leaf,
         CASE WHEN {_CRC} % 5 = 0 THEN sha256({_FIELDS} || {_marked(_LOWER.replace("coalesce(text, '')", 'text'))}) END AS altered
  FROM documents CROSS JOIN crc_table
),
docs AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
leaves AS (SELECT source AS g, pos, leaf AS node FROM docs),{_tree_sql('own', 'leaves')},
subroots AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, top AS node, g AS source FROM own_top),{_tree_sql('all', 'subroots')},
proofs AS (
  SELECT doc_id, leaf, altered, s.node AS subroot, t.top AS root, list_concat(o.steps, w.steps) AS steps
  FROM docs d JOIN own_way o ON d.source IS NOT DISTINCT FROM o.g AND d.pos = o.pos
  JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
  JOIN all_way w ON w.pos = s.pos CROSS JOIN all_top t
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
       list_reduce(list_prepend(coalesce(altered, leaf), steps),
                   lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2))) AS folded_root,
       folded_root = root AS verified
FROM proofs
"""


OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_ALNUM}) AS w FROM benchmark),
asked AS (SELECT item, item_id, unnest(w) AS term FROM items),
stats AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM docs WHERE len(w) > 0),
tfs AS (SELECT row, doc_id, n, term, count(*) AS tf
        FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM docs)
        WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, n, term),
dfs AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
        FROM tfs CROSS JOIN stats GROUP BY term, n_docs),
scores AS (
  SELECT item, item_id, row, doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY item, item_id, row, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express."""
    return {
        "op4_source_mix": OP4_SQL,
        "op5_chat_format": OP5_SQL,
        "op7_decontaminate": OP7_SQL,
        "op11_merkle": OP11_SQL,
        "op12_ranked_search": OP12_SQL,
    }
