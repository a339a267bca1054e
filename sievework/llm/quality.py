"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is a built-in expression; no user function runs. Cases: a null or blank text has no words and fails
the base rule; repeated rows are judged alike; every other column of the input is passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import SPACE, free_name, let, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Frequent function words of the corpus' languages.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "avec", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "als", "auch", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu", "im", "für",
    "como", "con", "del", "el", "las", "los", "más", "no", "para", "por", "se", "su", "una", "y",
)

#: metric, smallest allowed value, largest allowed value (None: no bound). Metrics are the keys of ``metrics``.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_ratio", 0.05, None),
    ("dup_line_ratio", None, 0.3),
)


def stop_forms(stop_words) -> list[str]:
    """Each stop word as it stands in running text: capitalised or not, bare or before a mark."""
    return sorted({f + mark for w in stop_words for f in (w, w[:1].upper() + w[1:]) for mark in ("", ",", ".", ";", ":", "!", "?")})


def repeated_words(words: Column) -> Column:
    """Words inside a five-word window that the text holds twice or more, all occurrences counted.

    A window is hashed to 64 bits, built from its words' hashes in three pairwise passes. Only where two hashes are equal are
    they sorted, as half a hash over the position in one primitive array; windows whose neighbour there has the same half are
    candidates. Every repeated window is among them, and they are compared by their words, so the count is exact.

    The words are bound once: a filter on the count is pushed below the projection that splits the text, and would
    otherwise split it again for each candidate."""
    return let(words, _repeated)


def _repeated(words: Column) -> Column:
    n = F.size(words)
    zero = F.lit(0).cast("long")

    def paired(x: Column, y: Column, by: int) -> Column:
        m = F.size(x) - by
        return F.zip_with(F.slice(x, F.lit(1), m), F.slice(y, F.lit(by + 1), m), lambda a, b: F.xxhash64(a, b))

    def five(one: Column) -> Column:
        return let(paired(one, one, 1), lambda two: let(paired(two, two, 2), lambda four: F.zip_with(
            four, F.slice(one, F.lit(WINDOW), F.size(four)), lambda a, b: F.xxhash64(a, b))))

    def covered(at: Column) -> Column:
        return let(F.sort_array(at), lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW).cast("long")))),
            zero, lambda acc, x: acc + x,
        ))

    def twice(ordered: Column, key, at) -> Column:
        """Positions of the elements whose neighbour has the same key."""
        same = lambda x, y: F.coalesce(key(x) == key(y), F.lit(False))
        return F.transform(F.filter(ordered, lambda x, j: same(F.get(ordered, j - 1), x) | same(F.get(ordered, j + 1), x)), at)

    def by_hash(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 32).bitwiseOR(i.cast("long"))))
        return let(packed, lambda o: twice(o, lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))))

    def by_words(at: Column) -> Column:
        windows = F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, (i + 1).cast("int"), F.lit(WINDOW)), " ").alias("w"), i.alias("i")))
        return let(F.sort_array(windows), lambda o: twice(o, lambda x: x["w"], lambda x: x["i"]))

    count = let(F.transform(words, lambda w: F.xxhash64(w)), lambda one: let(five(one), lambda h: (
        F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(by_words(by_hash(h)))))))
    return F.when(n <= WINDOW, zero).otherwise(count)


def measures(text: Column, words: Column, stop_words=STOP_WORDS) -> dict[str, Column]:
    """Whole-text counts."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    forms = stop_forms(stop_words)
    long = lambda c: c.cast("long")
    return {
        "n_words": long(F.size(words)),
        "word_chars": long(F.length(F.array_join(words, ""))),
        "n_symbols": long(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))),
        "n_lines": let(lines, lambda x: long(F.size(x))),
        "n_dup_lines": let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))),
        "n_repeat_words": repeated_words(words),
        "n_stop_words": long(F.size(F.filter(words, lambda w: w.isin(forms)))),
    }


def metrics(of) -> dict[str, Column]:
    """Ratios that rules may name, from the counts that ``of`` gives by name."""
    words = F.greatest(of("n_words"), F.lit(1))
    return {
        "n_words": of("n_words").cast("double"),
        "mean_word_chars": of("word_chars") / words,
        "symbols_per_word": of("n_symbols") / words,
        "stop_word_ratio": of("n_stop_words") / words,
        "dup_line_ratio": of("n_dup_lines") / F.greatest(of("n_lines"), F.lit(1)),
        "repeat_word_ratio": of("n_repeat_words") / words,
    }


def verdict(of, rules=RULES) -> Column:
    """The rules' conjunction as one boolean expression."""
    known, held = metrics(of), F.lit(True)
    for name, low, high in rules:
        if low is not None:
            held = held & (known[name] >= low)
        if high is not None:
            held = held & (known[name] <= high)
    return held


def judge(docs: DataFrame, rules=RULES, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct of the counts, ``base_failed`` and ``kept``; the struct's name is ``into``, with
    underscores before it if the input has such a column."""
    into = free_name(docs, into)
    w = free_name(docs, "words")
    counted = docs.withColumn(w, words_of(F.col(text))).withColumn(
        into, F.struct(*[c.alias(k) for k, c in measures(F.col(text), F.col(w)).items()])
    )
    of = lambda k: F.col(f"`{into}`.{k}")
    failed = (of("n_words") < 10) | (100 * of("n_repeat_words") > 20 * of("n_words"))
    return counted.withColumn(
        into,
        F.struct(f"`{into}`.*", failed.alias("base_failed"), (~failed & verdict(of, rules)).alias("kept")),
    ).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{into}`"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that pass, with their own columns only."""
    judged = judge(docs, rules)
    return judged.filter(F.col(f"`{judged.columns[-1]}`.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(rules=RULES, stop_words=STOP_WORDS) -> str:
    """The same verdicts in DuckDB SQL."""
    ratio = {
        "n_words": "n_words::DOUBLE", "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop_words / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
    }
    held = [f"{ratio[n]} >= {low}" for n, low, _ in rules if low is not None] + [f"{ratio[n]} <= {high}" for n, _, high in rules if high is not None]
    forms = ", ".join("'" + f.replace("'", "''") + "'" for f in stop_forms(stop_words))
    return rf"""
    WITH t AS (
      SELECT doc_id, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM documents
    ), win AS (
      SELECT doc_id, unnest(list_transform(range(1, len(w) - {WINDOW - 1} + 1), lambda i: {{'i': i, 'g': array_to_string(w[i:i + {WINDOW - 1}], ' ')}}), recursive := true)
      FROM t WHERE len(w) >= {WINDOW}
    ), keyed AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win
    ), rep AS (
      SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM keyed WHERE c > 1) GROUP BY doc_id
    ), counts AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(s) - length(regexp_replace(s, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: x IN ({forms})))::BIGINT AS n_stop_words
      FROM t LEFT JOIN rep USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
           NOT base_failed AND {' AND '.join(held)} AS kept
    FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
    """


def query(spark, sf_dir: str) -> DataFrame:
    from sievework.llm.common import table

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", *[f"quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept")]
    )
