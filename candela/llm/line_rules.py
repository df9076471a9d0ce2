"""Line-first cleaning of texts (DataFrame functions only).

Each line is judged on its own: it fails without a closing punctuation mark (punctuation), as a row of separated entries
(navigation), or as a notice, code, shouting, symbols or figures (boilerplate). Failed lines go; a text whose failed
lines hold over MAX_LOST % of its characters outside white space is rejected. Texts that are short or repeat
themselves are rejected before that. Everything is an expression over one row: nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: white space, a word, symbols, fewest words, most words (%) in repeated windows of three.
WHITE, WORD, SYMBOLS = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]+", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Most characters (%) that failed lines may take.
MAX_LOST = 30
#: Bits of a long that hold the place of a window; texts of more words take longer keys.
PLACE_BITS = 22
#: Marks that end a sentence, and closing marks after them. A line of LONG characters may break off after a whole sentence.
ENDS, CLOSING, LONG = ".!?…。！？", "\"'”’»)]", 60
#: Separators between entries of a menu: a line with two or more, one for every SPACED characters at least, is navigation.
SEPARATORS, SPACED = "|»›•·", 40
#: A line with a symbol for every SYMBOL_SPACE characters or fewer is not prose.
SYMBOL_SPACE = 60
#: Phrases of notices and controls; they mark a line of up to SHORT characters. (Java and RE2 read all patterns alike.)
SHORT = 200
PHRASES = (
    "all rights reserved", "copyright", "licensed under", "under the [a-z0-9 -]*licen[sc]e", "cookies?", "privacy policy", "terms of (use|service)",
    "sign (in|up)", "log ?in", "subscribe", "newsletter", "read more", "click here", "skip to content", "share (this|on)", "follow us",
    "javascript", "lorem ipsum", "powered by", "add to cart",
)
NOTICE = r"(?i)\b(" + "|".join(PHRASES) + r")\b|©"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for a row, however often body names it (also within lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, characters: str) -> Column:
    """How many of these characters the text holds."""
    return F.char_length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that the text holds twice or more.

    Hashes of windows are sorted with their places in one long each, which puts equal windows side by side; where part of
    a hash agrees and the words do not, the text is told apart by 96 bits of hashes instead. Each repeated window covers
    its own three words less those that the next one covers too.
    """
    at = lambda i: tuple(F.get(words, i + k) for k in range(WINDOW))
    n_windows = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    each = lambda key: F.transform(F.slice(words, 1, n_windows), lambda _, i: key(i))
    place, hashed = F.lit((1 << PLACE_BITS) - 1).cast("long"), F.lit(-1 << PLACE_BITS).cast("long")

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(b - a, F.lit(WINDOW).cast("long")))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, step: n + step)

    def by_structs(rs: Column) -> Column:
        same = lambda r, j: F.coalesce((r["a"] == F.get(rs, j)["a"]) & (r["b"] == F.get(rs, j)["b"]), F.lit(False))
        return F.sort_array(F.transform(F.filter(rs, lambda r, j: same(r, j - 1) | same(r, j + 1)), lambda r: r["i"]))

    def by_longs(ks: Column) -> Column:
        near = lambda k, j: F.coalesce(k.bitwiseXOR(F.get(ks, j)).bitwiseAND(hashed) == 0, F.lit(False))
        # Where the next key agrees, the words must too; if some don't, the longer keys decide.
        found = F.filter(ks, lambda k, j: near(k, j - 1) | near(k, j + 1))
        place_of = lambda k: k.bitwiseAND(place).cast("int")

        def checked(fs: Column) -> Column:
            other = lambda k, j: F.get(fs, j + 1)
            unlike = lambda k, j: near_pair(k, other(k, j)) & (F.array(*at(place_of(k))) != F.array(*at(place_of(other(k, j)))))
            near_pair = lambda k, o: k.bitwiseXOR(o).bitwiseAND(hashed) == 0
            collide = F.size(F.filter(fs, lambda k, j: F.coalesce(unlike(k, j), F.lit(False)))) > 0
            exact = lambda: let(F.sort_array(each(lambda i: F.struct(F.xxhash64(*at(i)).alias("a"), F.hash(*at(i)).alias("b"), i.cast("long").alias("i")))), by_structs)
            return F.when(collide, exact()).otherwise(F.sort_array(F.transform(fs, lambda k: k.bitwiseAND(place))))

        return let(let(found, checked), covered)

    packed = F.sort_array(each(lambda i: F.xxhash64(*at(i)).bitwiseAND(hashed).bitwiseOR(i.cast("long"))))
    return F.when(F.size(words) <= 1 << PLACE_BITS, let(packed, by_longs)).otherwise(
        let(F.sort_array(each(lambda i: F.struct(F.xxhash64(*at(i)).alias("a"), F.hash(*at(i)).alias("b"), i.cast("long").alias("i")))), lambda rs: let(by_structs(rs), covered))
    )


def _line_fails(line: Column, chars: Column, symbols: Column) -> Column:
    """Whether a line (with a word) fails a rule; the cheap ones come first, and each ends the search."""
    bare, separators = F.rtrim(line, F.lit(WHITE + CLOSING)), _count(line, SEPARATORS)
    any_of = lambda tests: reduce(Column.__or__, tests)
    ended = any_of([F.endswith(bare, F.lit(e)) for e in ENDS]) | ((chars >= LONG) & any_of([F.contains(line, F.lit(e + " ")) for e in ENDS]))
    navigation = (separators >= 2) & (separators * SPACED >= chars)
    loud = ~F.rlike(line, F.lit(r"\p{Ll}")) & F.rlike(line, F.lit(r"(\p{Lu}[^\p{Lu}]*){4}"))
    figures = ~F.rlike(line, F.lit(r"\p{L}")) & F.rlike(line, F.lit("[0-9]"))
    notice = (chars <= SHORT) & F.rlike(line, F.lit(NOTICE))
    code = F.contains(line, F.lit("{")) | F.contains(line, F.lit("}"))
    return ~ended | (symbols * SYMBOL_SPACE > chars) | code | navigation | loud | figures | notice


def clean_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_lost: int = MAX_LOST) -> DataFrame:
    """One row per row of df: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned (the
    text without its failed lines), n_failed_lines and failed_chars (outside white space).

    A null or empty text has no words, fails the base rules and is cleaned to an empty one. Lines without a word neither
    fail nor count. Null ids stay, rows that repeat give a row each, other columns are left out whatever their names,
    and an empty table gives an empty result. Texts are read whole, however long; time grows as n log n with them.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    plain = F.when(F.rlike(text, F.lit(r"[\t\x0B-\x0D]")), F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)
    words = lambda line: F.array_remove(F.split(line, " ", -1), "")
    total = lambda xs, name: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x[name])

    def of_line(line: Column, spaced: Column) -> Column:
        def sized(ws: Column) -> Column:
            return let(F.struct(F.char_length(F.array_join(ws, "")).cast("long").alias("chars"), _count(line, SYMBOLS).alias("symbols")), lambda c: judged(ws, c))

        def judged(ws: Column, c: Column) -> Column:
            failed = F.when(c["chars"] > 0, _line_fails(line, c["chars"], c["symbols"])).otherwise(F.lit(False))
            return F.struct(line.alias("line"), ws.alias("words"), c["chars"].alias("chars"), c["symbols"].alias("symbols"), failed.alias("failed"))

        return let(words(spaced), sized)

    def of_text(ls: Column) -> Column:
        full, failed = F.transform(F.filter(ls, lambda x: x["chars"] > 0), lambda x: x["line"]), F.filter(ls, lambda x: x["failed"])
        by_word = let(F.flatten(F.transform(ls, lambda x: x["words"])), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _repeat_words(ws).alias("n_repeat_words")))
        return F.struct(
            by_word.alias("w"),
            total(ls, "chars").alias("word_chars"),
            total(ls, "symbols").alias("n_symbols"),
            let(full, lambda xs: (F.size(xs) - F.size(F.array_distinct(xs))).cast("long")).alias("n_dup_lines"),
            F.array_join(F.transform(F.filter(ls, lambda x: ~x["failed"]), lambda x: x["line"]), "\n").alias("cleaned"),
            F.size(failed).cast("long").alias("n_failed_lines"),
            total(failed, "chars").alias("failed_chars"),
        )

    lines = F.zip_with(F.split(text, "\n", -1), F.split(plain, "\n", -1), of_line)
    out = df.select(df[id_col].alias("_id"), let(lines, of_text).alias("j")).select("_id", "j.w.*", "j.*").drop("w")
    base_failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    kept = ~F.col("base_failed") & (F.col("failed_chars") * 100 <= F.col("word_chars") * max_lost)
    out = out.withColumn("base_failed", base_failed).withColumn("kept", kept)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned", "n_failed_lines", "failed_chars"]
    return out.select(F.col("_id").alias(id_col), *names)


def op11_line_rules(spark, sf_dir: str) -> DataFrame:
    out = clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("cleaned_sha256", F.sha2(F.col("cleaned").cast("binary"), 256)).drop("cleaned")


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CLOSING = "'" + CLOSING.replace("'", "''") + "'"
_COUNT = "length(line) - length(translate(line, '{}', ''))".format

OP11_SQL = rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (select r, regexp_extract_all(text, '{WORD}') as ws from t),
windows as (select r, unnest(range(1, len(ws) - 1)) as i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) as w from words),
seen as (select r, i, count(*) over (partition by r, w) as n from windows),
covered as (select r, count(distinct pos) as n from (select r, unnest([i, i + 1, i + 2]) as pos from seen where n > 1) group by r),
lines as (
  select r, pos, line, length(translate(line, {_WHITE}, '')) as chars, {_COUNT(SYMBOLS)} as symbols, {_COUNT(SEPARATORS)} as separators,
    right(rtrim(line, {_WHITE} || {_CLOSING}), 1) in ({", ".join(f"'{e}'" for e in ENDS)}) as ended
  from (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from t)),
judged as (
  select *, chars > 0 and (not (ended or (chars >= {LONG} and regexp_matches(line, '[{ENDS}] '))) or symbols * {SYMBOL_SPACE} > chars
    or regexp_matches(line, '[{{}}]') or (separators >= 2 and separators * {SPACED} >= chars)
    or (not regexp_matches(line, '\p{{Ll}}') and regexp_matches(line, '(\p{{Lu}}[^\p{{Lu}}]*){{4}}'))
    or (not regexp_matches(line, '\p{{L}}') and regexp_matches(line, '[0-9]')) or (chars <= {SHORT} and regexp_matches(line, '{NOTICE}'))) as failed
  from lines),
by_line as (
  select r, count(*) filter (chars > 0) - count(distinct line) filter (chars > 0) as n_dup_lines,
    coalesce(string_agg(line, chr(10) order by pos) filter (not failed), '') as cleaned,
    count(*) filter (failed) as n_failed_lines, cast(coalesce(sum(chars) filter (failed), 0) as bigint) as failed_chars
  from judged group by r),
joined as (
  select doc_id, cast(len(ws) as bigint) as n_words, length(translate(text, {_WHITE}, '')) as word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) as n_symbols, coalesce(c.n, 0) as n_repeat_words, by_line.* exclude (r)
  from t join words using (r) join by_line using (r) left join covered c using (r)),
based as (select *, n_words < {LEAST_WORDS} or n_repeat_words * 100 > n_words * {MOST_REPEATED} as base_failed from joined)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and failed_chars * 100 <= word_chars * {MAX_LOST} as kept, n_failed_lines, failed_chars, sha256(cleaned) as cleaned_sha256
from based
"""
