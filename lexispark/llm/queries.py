"""Registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, classifier, linededup, merkle, neardup, packing, pii, quality, spelling, spiece, spotsigs, tokenbin, urlfilter


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_read(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_read(spark, sf_dir, "documents"), report=True)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_probe(_read(spark, sf_dir, "conversations"))))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.digest(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(_read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_best_fit_packing, op3_personal_data, op4_token_files, op5_line_dedup, op6_chat_formatting, op7_sentence_pieces, op8_url_filters, op9_fingerprints, op10_near_duplicates,
           op11_quality_classifier, op12_spelling_variants, op13_merkle_manifest)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op6_chat_formatting": OP6, "op12_spelling_variants": OP12, "op13_merkle_manifest": OP13}


_STOP = ", ".join("'" + f + "'" for s in quality.STOP_WORDS for f in (s, s.capitalize()))
_BOUNDS = " AND ".join(
    f"{b}" for r in quality.RULES for b in [f"{r.numerator} >= {r.denominator} * CAST({r.low} AS DOUBLE)"] * (r.low is not None) + [f"{r.numerator} <= {r.denominator} * CAST({r.high} AS DOUBLE)"] * (r.high is not None)
)
OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, unnest(range(0, 8)) AS u(k) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
         CAST(len(list_filter(w, lambda x: x IN ({_STOP}))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_BOUNDS} AS kept FROM b
"""

OP6 = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, contains(role || text, '###') OR contains(role || text, '</turn>') OR contains(role, ':' || chr(10)) OR contains(role, '\') OR regexp_matches(text, '\\(.|\n)') AS odd FROM c),
f AS (
  SELECT *, CASE WHEN odd THEN length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')) ELSE length(text) END AS n_text,
            CASE WHEN odd THEN length(replace(replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:'), chr(10), '\' || chr(10))) ELSE length(role) END AS n_role
  FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_text + n_role + 14) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def _crc32(text: str) -> str:
    """The CRC-32 of an ASCII or UTF-8 text in SQL: each byte, then eight shifts (marked by -1)."""
    hexes = f"hex(encode({text}))"
    steps = f"flatten(list_transform(range(0, length({hexes}) // 2), lambda i: list_concat([CAST('0x' || substr({hexes}, 2 * i + 1, 2) AS BIGINT)], list_transform(range(0, 8), lambda j: CAST(-1 AS BIGINT)))))"
    fold = "lambda c, x: CASE WHEN x < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), {fold}), 4294967295)"


#: One letter for each of the letters a word can have, so that distances in bytes are distances in letters.
_LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_ASCII = "".join(chr(c) for c in range(35, 127) if c not in (39, 92))[: len(_LATIN)]
OP12 = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{5,}}')) AS run FROM documents WHERE text IS NOT NULL),
low AS (SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT run, k, {_crc32("d || ':' || run")} AS h FROM low),
words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS (SELECT word, n, unnest(list_distinct(list_concat([word], list_transform(range(0, length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2))))) AS part FROM words),
met AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (part) WHERE a.word <> b.word),
near AS (
  SELECT * FROM met WHERE levenshtein(translate(word, '{_LATIN}', '{_ASCII}'), translate(near, '{_LATIN}', '{_ASCII}')) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS form, max(near_n) AS form_n FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f LEFT JOIN ends e USING (word)
"""


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))


def _levels(name: str, base: str) -> str:
    """All levels of the trees of ``base`` (g, k, h) as ``name`` (g, level, k, n, h), and for each node its siblings."""
    return f"""
{name} AS (
  SELECT g, 0 AS level, k, count(*) OVER (PARTITION BY g) AS n, h FROM {base}
  UNION ALL SELECT g, level + 1, k // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY k)) FROM {name} WHERE n > 1 GROUP BY g, level, k // 16),
{name}_near AS MATERIALIZED (
  SELECT g, level, k, coalesce(string_agg(h, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(h, '') OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {name} WHERE n > 1 WINDOW o AS (PARTITION BY g, level, k // 16 ORDER BY k))"""


OP13 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS g, sha256({_HEAD} || {_field("text")}) AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0
              THEN sha256({_HEAD} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed
  FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d),
low_base AS (SELECT g, k, leaf AS h FROM l),{_levels("low", "low_base")},
tops AS MATERIALIZED (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS k FROM low WHERE n = 1),
top_base AS (SELECT 0 AS g, k, subroot AS h FROM tops),{_levels("up", "top_base")},
root AS (SELECT h AS root FROM up WHERE n = 1),
path AS MATERIALIZED (
  SELECT l.rid, x.level, x.lft, x.rgt FROM l JOIN low_near x ON x.g = l.g AND x.k = CAST(floor(l.k / pow(16, x.level)) AS BIGINT)
  UNION ALL
  SELECT l.rid, 100 + x.level, x.lft, x.rgt FROM l JOIN tops t ON t.source = l.g JOIN up_near x ON x.k = CAST(floor(t.k / pow(16, x.level)) AS BIGINT)),
steps AS MATERIALIZED (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY level) AS s, count(*) OVER (PARTITION BY rid) AS n, lft, rgt FROM path),
fold AS (
  SELECT rid, 0 AS s, coalesce(changed, leaf) AS h FROM l
  UNION ALL SELECT fold.rid, steps.s, sha256(steps.lft || fold.h || steps.rgt) FROM fold JOIN steps ON steps.rid = fold.rid AND steps.s = fold.s + 1),
folded AS (SELECT rid, arg_max(h, s) AS folded_root FROM fold GROUP BY rid),
proof AS (SELECT rid, sha256(string_agg(lft || rgt, '' ORDER BY s)) AS proof_sha256 FROM steps GROUP BY rid)
SELECT l.doc_id, l.leaf, t.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.root AS verified
FROM l JOIN tops t ON t.source = l.g CROSS JOIN root r JOIN folded f USING (rid) LEFT JOIN proof p USING (rid)
"""
