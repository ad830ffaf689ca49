"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of the sentence rule (delimiters, closers, alphanumerics) and its breaks.
DELIMITERS, CLOSERS = r"\[\\.!?\]．。！？…", r"\[\\)（」』】］〕〉》\]"
ALNUM = r"0-9A-z０-９Ａ-Ｚａ-ｚ"
SENTENCE_BREAK = rf"(?<=[^{CLOSERS}{DELIMITERS}])(。|(?<=[^{ALNUM}])[{DELIMITERS}]|[{DELIMITERS}](?=[^{ALNUM}]))(?=.)"


def split_sentences(line: Column) -> Column:
    """array<string>: a break follows a delimiter that neither belongs to a number nor follows a closer or another delimiter."""
    return F.filter(F.split(F.regexp_replace(line, SENTENCE_BREAK, "$1\n"), "\n"), lambda s: s != "")


def to_full_width(text: Column) -> Column:
    """ASCII and half-width punctuation to full width; ``．`` and ``，`` to ``。`` and ``、``."""
    narrow = [chr(c) for c in range(0x21, 0x7F)] + [" "]
    wide = [chr(c + 0xFEE0) for c in range(0x21, 0x7F)] + ["　"]
    full = F.translate(F.translate(text, "".join(narrow), "".join(wide)), "｡｢｣､･", "。「」、・")
    return F.translate(full, "．，", "。、")


def normalize_text(text: Column) -> Column:
    """NFC, half-width kana composed to full width, then to_full_width. The first two need Unicode tables that Spark lacks."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def compose(s):
        import unicodedata

        kana = re.compile("[｡-ﾟ]+")
        return s.map(lambda x: x if x is None else kana.sub(lambda m: unicodedata.normalize("NFKC", m[0]), unicodedata.normalize("NFC", x)))

    compose.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return to_full_width(pandas_udf(compose, "string")(text))


def strip_token_space(orth: Column) -> Column:
    return F.regexp_replace(orth, r"[\s　]+", "")


# Character classes of the readability counts; the first that holds a character counts it.
HIRAGANA, KANJI, KATAKANA = r"ぁ-ゟ", r"一-鿿", r"゠-ヿ"
ROMAJI = r"A-zＡ-ｚ0-9０-９"
COMMAS, COMMAS_AS_PUBLISHED = r"、，,", r"、＋,"
CLASSES = {"hiragana": HIRAGANA, "kanji": KANJI, "katakana": KATAKANA, "romaji": ROMAJI}


def char_class_counts(text: Column, mode: str = "fixed") -> dict[str, Column]:
    """Characters of each script, commas, and all others as symbols. ``mode='reference'`` counts the full-width plus as comma."""
    commas = COMMAS_AS_PUBLISHED if mode == "reference" else COMMAS
    counts = {n: F.regexp_count(text, F.lit(f"[{c}]")) for n, c in CLASSES.items()}
    counts["commas"] = F.regexp_count(text, F.lit(f"[{commas}]"))
    known = sum(counts.values(), F.lit(0))
    return counts | {"symbols": F.length(text) - known}


def char_runs(text: Column) -> dict[str, Column]:
    """For each script, its share of all runs in percent and its mean run length; all other characters count as romaji."""
    others = "".join((HIRAGANA, KANJI, KATAKANA))
    found = {n: F.regexp_extract_all(text, F.lit(f"[{c}]+" if n != "romaji" else f"[^{others}]+"), F.lit(0)) for n, c in CLASSES.items()}
    total = sum((F.size(f) for f in found.values()), F.lit(0))
    out = {}
    for n, f in found.items():
        chars = F.aggregate(f, F.lit(0), lambda a, x: a + F.length(x))
        out[f"{n}_percent"] = F.coalesce(F.try_divide(100.0 * F.size(f), total), F.lit(0.0))
        out[f"{n}_mean"] = F.coalesce(F.try_divide(chars.cast("double"), F.size(f)), F.lit(0.0))
    return out


def shibasaki_grade(hiragana: Column, characters: Column, chunks: Column) -> Column:
    """School year of a text from its hiragana count, mean characters and chunks of a sentence; null for a text without characters."""
    # Published coefficients.
    h, ch, cu = F.try_divide(hiragana.cast("double"), characters), characters.cast("double"), chunks.cast("double")
    terms = (
        (3.601e-4, h), (-8.772e-2, h * h), (6.651, h), (3.679, cu), (3.142e-4, h * h * ch), (-3.986e-4, h * h * cu),
        (-3.207e-4, h * ch * ch), (-3.109e-2, h * ch), (-7.968e-3, h * cu * cu), (3.468e-3, h * ch * cu),
    )
    return sum((x * c for c, x in terms), F.lit(-147.9))


def tateishi_score(characters: Column, commas: Column, periods: Column, runs: dict[str, Column]) -> Column:
    """Ease of reading from mean sentence length, commas a period, and char_runs()."""
    # Published coefficients.
    parts = {"romaji_percent": 0.06, "hiragana_percent": 0.25, "kanji_percent": -0.19, "katakana_percent": -0.61, "romaji_mean": -1.35, "hiragana_mean": 7.52, "kanji_mean": 22.10, "katakana_mean": 5.30}
    return sum((runs[n] * c for n, c in parts.items()), -1.34 * characters - 3.87 * F.try_divide(commas.cast("double"), periods) - 109.1)


def recode_pos(pos_1: Column, pos_2: Column, pos_3: Column, c_type: Column, lemma: Column) -> Column:
    """Eleven word classes from morphological part of speech."""
    full = F.concat(*[F.coalesce(p, F.lit("")) for p in (pos_1, pos_2, pos_3)])
    lemma, c_type, pos_2 = (F.coalesce(c, F.lit("")) for c in (lemma, c_type, pos_2))
    connective = ((pos_2 == "接続助詞") & lemma.rlike("^(て|ば)$")) | lemma.rlike("^たり$")
    # Patterns and classes, tried in this order.
    cases = (
        ("^動詞", F.lit("verb")), ("^(副詞|名詞.+副詞可能)", F.lit("adverb")), ("^(代?名詞[^副]+|記号文字)", F.lit("noun")),
        ("^(形(容|状)詞|接尾辞形(容|状)詞的)", F.lit("adjective")), ("^助詞", F.when(connective, "auxiliary-verb").otherwise("particle")),
        ("^接続詞", F.lit("particle")), ("^((補助)?記号|空白)", F.lit("symbol")),
        ("^助動詞", F.when(c_type.rlike("^助動詞-(ダ|デス)$"), "particle").otherwise("auxiliary-verb")), ("^連体詞", F.lit("preposition")),
        ("^感動詞", F.lit("utterance")), ("^接頭辞", F.lit("prefix")),
        ("^接尾辞", F.when(pos_2 == "動詞的", "adjective").when(pos_2 == "名詞的", "noun").otherwise("suffix")),
    )
    out = F.when(full.rlike(cases[0][0]), cases[0][1])
    for pattern, value in cases[1:]:
        out = out.when(full.rlike(pattern), value)
    return out.otherwise("unknown-pos")


def recode_tags(pos: Column, lemma: Column, c_type: Column, c_form: Column, orth: Column, ne: Column) -> Column:
    """array<string> of grammatical tags, and the named-entity class in lower case."""
    lemma, c_type, c_form, orth = (F.coalesce(c, F.lit("")) for c in (lemma, c_type, c_form, orth))
    tags = lambda *t: F.array(*map(F.lit, t))
    none = F.array().cast("array<string>")
    # Lemmas of verbs and adjectives with a tag of their own.
    verbs = {"出来る": "dekiru", "居る": "iru", "仕舞う": "simau", "ちゃう": "simau", "来る": "kuru", "貰う": "morau", "上げる": "ageru"}
    adjectives = {"無い": "negative", "易い": "teido", "難い": "teido", "様": "you", "欲しい": "hoshii", "良い": "ii", "そう-伝聞": "sou-dengon"}

    def by_lemma(of: dict[str, str]) -> Column:
        out = F.when(F.lit(False), none)
        for k, v in of.items():
            out = out.when(lemma == k, tags(v))
        return out.otherwise(none)

    auxiliary = (
        F.when((c_type == "助動詞-タ") & c_form.contains("仮定形"), tags("potential")).when(c_type == "助動詞-タ", tags("past"))
        .when(c_type.rlike("^助動詞-(ナイ|ヌ)$") & orth.rlike("く$"), tags("aspect-ku", "negative"))
        .when(c_type.rlike("^助動詞-(ナイ|ヌ)$") & c_form.startswith("仮定形"), tags("potential"))
        .when(c_type.rlike("^助動詞-(ナイ|ヌ)$"), tags("negative"))
        .when(lemma.rlike("^ら?れる$"), tags("passive")).when(lemma.rlike("^さ?せる$"), tags("active"))
        .when(c_type.rlike("^助動詞-(マス|デス)$"), tags("polite"))
        .when(lemma == "て", tags("aspect")).when(lemma == "ば", tags("potential")).when(lemma == "たり", tags("tari")).otherwise(none)
    )
    own = F.when(pos == "verb", by_lemma(verbs)).when(pos == "adjective", by_lemma(adjectives)).when(pos == "auxiliary-verb", auxiliary).otherwise(none)
    entity = F.when(ne.isNotNull() & (ne != "O"), F.array(F.lower(F.regexp_replace(ne, "[BI]-", "")))).otherwise(none)
    return F.array_union(own, entity)


ASPECT_PARTS = ("iru", "simau", "kuru", "hoshii", "ii")


def unify_aspect_tags(tags: Column) -> Column:
    """aspect with some of ASPECT_PARTS becomes one ``aspect-a+b``; without aspect these parts are dropped."""
    parts = F.array_sort(F.array_intersect(tags, F.array(*map(F.lit, ASPECT_PARTS))))
    rest = F.array_except(tags, F.array(*map(F.lit, ("aspect", *ASPECT_PARTS))))
    joined = F.concat(rest, F.array(F.concat(F.lit("aspect-"), F.array_join(parts, "+"))))
    return F.when(F.size(parts) == 0, tags).when(F.array_contains(tags, "aspect"), joined).otherwise(rest)


def highlight_spans(text: Column, spans: Iterable[tuple[Column, Column, str]]) -> Column:
    """Wraps each [begin, end) of a text in a span with its class; spans are given left to right and put in right to left."""
    out = text
    for begin, end, name in reversed(list(spans)):
        out = F.concat(F.substring(out, F.lit(1), begin), F.lit(f'<span class="{name}">'), F.substring(out, begin + 1, end - begin), F.lit("</span>"), F.substr(out, end + 1))
    return out


def kwic(text: Column, pattern: str) -> Column:
    """array<struct<before, key, after>> of all matches of a pattern; before + key + after is the text."""
    if re.match(pattern, ""):
        raise ValueError("a pattern that fits the empty string has no matches to show")
    keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))

    def at(i: Column) -> Column:
        """Characters before match i."""
        plain = F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)
        return plain + F.aggregate(F.slice(keys, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))

    return F.transform(keys, lambda k, i: F.struct(F.substring(text, F.lit(1), at(i)).alias("before"), k.alias("key"), F.substr(text, at(i) + F.length(k) + 1).alias("after")))
