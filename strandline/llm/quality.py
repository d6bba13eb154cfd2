"""Quality rules, line first: lines are judged one by one, the failing ones removed, and
documents that lose too much of their text are rejected.

Three rules fail a line that has a word:

punctuation  no sentence ends in it (closing quotes and brackets aside), or symbols and
             exclamation marks make up a large part of its characters;
navigation   it is cut by three or more separators such as | or ›;
boilerplate  it is short and holds a phrase of notices, menus and forms.

Only DataFrame functions are used. Every rule sees the whole text of one row, so there is
no shuffle at all, and neither hot sources nor copies meet anywhere.

Null and empty texts have no words, all counts are 0 and they are not kept. Rows are
judged one by one: repeated rows get equal results, and a very long text is judged whole.
Other columns stay as they are; those named like a column of the result are replaced. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, WORD, aside, bind, n_words, restored, table, words

SYMBOLS = "[#*$%&|<>]"
#: Signs that prose uses sparingly.
NOISE = r"[#*$%&|<>!~^=+_{}\[\]@\\]"
SEPARATORS = "[|»›•·]"
ENDS = r"[.!?…:;。！？][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
#: Phrases of notices, menus and forms in the languages of the corpus; ' stands for any apostrophe, accents may be of either case.
PHRASES = {
    "en": r"all rights reserved|copyright|\(c\) \d{4}|©|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum|click here|sign (in|up)|log ?in|subscribe|newsletter|read more|share (this|on)|licensed under|permission is hereby granted",
    "de": r"alle rechte vorbehalten|datenschutz|impressum|nutzungsbedingungen|hier klicken|anmelden|registrieren|abonnieren|weiterlesen|mehr erfahren",
    "fr": r"tous droits réservés|politique de confidentialité|conditions d'utilisation|mentions légales|cliquez ici|se connecter|s'inscrire|s'abonner|lire la suite|en savoir plus",
    "es": r"todos los derechos reservados|política de privacidad|condiciones de uso|aviso legal|haga clic aquí|iniciar sesión|registrarse|suscribirse|leer más|boletín",
}
_EITHER = {"'": "['’]", **{c: f"[{c}{c.upper()}]" for c in "éíóá"}}
BOILERPLATE = "(?i)(" + "".join(_EITHER.get(c, c) for c in "|".join(PHRASES.values())) + ")"


def repeated_window_words(text_words: Column, width: int = 8) -> Column:
    """How many words stand in windows of `width` words that the text has twice or more.

    The windows' hashes come from pairs, fours and eights (width must be a power of two).
    Only if two are equal are they sorted with their positions to find which; no step
    takes more than n log n for n words.
    """

    def doubled(step: int):
        return lambda a: F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    h, size = F.transform(text_words, lambda w: F.xxhash64(w)), 1
    while size < width:
        h, size = bind(h, doubled(size)), 2 * size
    h = bind(h, lambda a: F.slice(a, 1, F.greatest(F.size(a) - (width - 1), F.lit(0))))

    def covered(a: Column) -> Column:
        pairs = F.sort_array(F.transform(a, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda p: F.transform(p, lambda x, j: F.when((F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]), x["i"]))
        at = F.sort_array(F.array_compact(bind(pairs, twice)))
        gaps = lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.lit(width), F.coalesce(y - x, F.lit(width))))
        return F.aggregate(bind(at, gaps), F.lit(0).cast("bigint"), lambda s, x: s + x)

    return bind(h, lambda a: F.when(F.size(F.array_distinct(a)) < F.size(a), covered(a)).otherwise(F.lit(0).cast("bigint")))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.withColumn("_w", words(F.col(text)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    counted = with_words.withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("bigint"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": F.when(F.size("_w") > 8, repeated_window_words(F.col("_w"))).otherwise(F.lit(0)).cast("bigint"),
    }).drop("_w")
    return counted.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def line_passes(line: Column, max_noise: float, short_line: int) -> Column:
    """Whether a line stays. Lines without a word always do."""
    noise = F.regexp_count(line, F.lit(NOISE)) > max_noise * F.length(line)
    boilerplate = (F.length(line) <= short_line) & line.rlike(BOILERPLATE)
    return ~line.rlike(WORD) | (line.rlike(ENDS) & ~noise & (F.regexp_count(line, F.lit(SEPARATORS)) < 3) & ~boilerplate)


def clean_lines(docs: DataFrame, text: str = "text", max_noise: float = 0.1, short_line: int = 200) -> DataFrame:
    """docs with clean_text, the lines that pass, and n_lines_removed."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    judged = docs.withColumn("_kept", bind(lines, lambda ls: F.struct(F.size(ls).alias("n"), F.filter(ls, lambda x: line_passes(x, max_noise, short_line)).alias("lines"))))
    return judged.withColumns({"clean_text": F.array_join("_kept.lines", "\n"), "n_lines_removed": (F.col("_kept.n") - F.size("_kept.lines")).cast("bigint")}).drop("_kept")


def quality_rules(docs: DataFrame, text: str = "text", max_loss: float = 0.3) -> DataFrame:
    """docs with the base counts, clean_text, n_lines_removed, clean_words and kept.

    kept is false where base_failed is true or more than max_loss of the words went.
    """
    judged = clean_lines(base_counts(docs, text), text)
    return judged.withColumn("clean_words", n_words(F.col("clean_text"))).withColumn("kept", ~F.col("base_failed") & (F.col("clean_words") >= (1 - max_loss) * F.col("n_words")))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "clean_words")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others have their failing lines removed.

    A generator instead of a filter keeps the optimizer from judging each text twice.
    """
    judged = quality_rules(docs.select("text", *aside(docs)))
    kept = judged.withColumn("_clean", F.explode(F.when(F.col("kept"), F.array("clean_text")).otherwise(F.array())))
    return kept.select(*restored(docs, text=F.col("_clean"), n_chars=F.length("_clean").cast("bigint")))


_DUCK_ENDS, _DUCK_BOILERPLATE = ENDS.replace("'", "''"), BOILERPLATE.replace("'", "''")
#: Rows are numbered, as ids may repeat.
BASE_SQL = f"""d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM @docs),
  w AS (SELECT rid, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS w FROM d),
  win AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
  twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
  rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
  ln AS (SELECT rid, p, s, regexp_matches(s, '{WORD}') AS has FROM (SELECT rid, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d)),
  dup AS (SELECT rid, count(*) - count(DISTINCT s) AS n FROM ln WHERE has GROUP BY 1),
  fate AS (SELECT rid, p, s, NOT has OR (regexp_matches(s, '{_DUCK_ENDS}') AND len(regexp_replace(s, '{NOISE.replace("[", "[^", 1)}', '', 'g')) <= 0.1::DOUBLE * len(s)
    AND len(regexp_replace(s, '{SEPARATORS.replace("[", "[^")}', '', 'g')) < 3 AND NOT (len(s) <= 200 AND regexp_matches(s, '{_DUCK_BOILERPLATE}'))) AS pass FROM ln),
  clean AS (SELECT rid, coalesce(string_agg(s, chr(10) ORDER BY p) FILTER (pass), '') AS clean_text, count(*) FILTER (NOT pass) AS n_lines_removed FROM fate GROUP BY 1),
  q AS (SELECT d.*, len(w.w) AS n_words, len(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_lines_removed, clean_text,
    len(list_filter(regexp_split_to_array(clean_text, '{SPACE}+'), lambda x: x <> '')) AS clean_words
    FROM d JOIN w USING (rid) JOIN clean USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
  judged AS (SELECT *, NOT base_failed AND clean_words >= (1 - 0.3::DOUBLE) * n_words AS kept FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q))"""

SQL = f"WITH {BASE_SQL.replace('@docs', 'documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, clean_words FROM judged"
