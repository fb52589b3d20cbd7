"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rule: space and the control characters 9 to 13.
BLANK = " \t\n\x0b\x0c\r"
#: Words in one window of the repetition count.
WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is it that for was on are as with at by this be from or an "
    "le la les de des du et en un une que qui dans pour est sur au aux par "
    "der die das und ist von zu mit den auf nicht ein eine für im es "
    "el los las y que del se por con para una no"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie within least and most (either may be open) for a text to be kept."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Production thresholds on length, symbols, stop words and lines.
RULES = (
    Rule("length", "n_words", 20, 1_000_000),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 2.0, 12.0),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", None, 0.1),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", 0.01, None),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
)


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value. Written in place, value would be worked out again in each step of
    body's lambdas; as a lambda's own variable it is worked out once for each row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words() -> str:
    """Words covered by windows whose 64-bit hash occurs twice or more in the text; equal hashes are confirmed on
    the words. Hashes of two, four and eight words are made by doubling, and where no four words in a row occur twice
    the rest is left out."""
    same = f"x.h = p.h and slice(w, x.i + 1, {WINDOW}) = slice(w, p.i + 1, {WINDOW})"
    marked = (
        "transform(s, (x, k) -> if("
        f"(k > 0 and {_let('s[k - 1]', 'p', same)}) or (k < size(s) - 1 and {_let('s[k + 1]', 'p', same)}), x.i, null))"
    )
    order = "array_sort(transform(h, (v, i) -> struct(v as h, i as i)))"
    starts = f"array_sort(filter({_let(order, 's', marked)}, i -> i is not null))"
    covered = f"aggregate(transform(d, (i, k) -> if(k < size(d) - 1, least({WINDOW}, d[k + 1] - i), {WINDOW})), 0L, (a, n) -> a + n)"
    twice = f"if(size(array_distinct(h)) = size(h), 0L, {_let(starts, 'd', covered)})"
    two = "transform(w, (x, i) -> xxhash64(x, get(w, i + 1)))"
    four = "transform(g, (x, i) -> xxhash64(x, get(g, i + 2)))"
    eight = f"slice(transform(f, (x, i) -> xxhash64(x, get(f, i + 4))), 1, size(w) - {WINDOW - 1})"
    seen = f"if(size(array_distinct(f)) = size(f), 0L, {_let(eight, 'h', twice)})"
    return f"if(size(w) < {WINDOW + 1}, 0L, {_let(two, 'g', _let(f'slice({four}, 1, size(w) - 3)', 'f', seen))})"


def _sql_text(text: str) -> str:
    return "'" + "".join({"\t": "\\t", "\n": "\\n", "\r": "\\r", "\x0b": "\\u000B", "\x0c": "\\u000C"}.get(c, c) for c in text) + "'"


def measures(text: str = "text") -> Column:
    """A struct of the counts that the rules use, for every whole text of that column; a null text has no words
    and no lines."""
    blank, stops = _sql_text(BLANK), ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = f"if(btrim(t, {blank}) = '', cast(array() as array<string>), split(btrim(t, {blank}), {_sql_text('[ \t-\r]+')}))"
    lines = f"filter(split(t, {_sql_text(chr(10))}), l -> btrim(l, {blank}) <> '')"
    bare = "t"
    for sign in SYMBOLS:
        bare = f"replace({bare}, '{sign}', '')"
    counts = f"""named_struct(
        'n_words', cast(size(w) as bigint),
        'word_chars', cast(char_length(array_join(w, '')) as bigint),
        'n_symbols', cast(octet_length(t) - octet_length({bare}) as bigint),
        'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint),
        'n_repeat_words', {_repeat_words()},
        'n_lines', cast(size(l) as bigint),
        'n_stop_words', cast(size(filter(w, x -> x in ({stops}))) as bigint))"""
    return F.expr(_let(f"coalesce(cast(`{text}` as string), '')", "t", _let(words, "w", _let(lines, "l", counts))))


def verdict(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL that holds where every rule does."""
    tests = []
    for r in rules:
        tests += [f"({r.measure}) >= {r.least}"] * (r.least is not None) + [f"({r.measure}) <= {r.most}"] * (r.most is not None)
    return "(" + " and ".join(tests) + ")"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs' doc_id with the counts of its whole text, base_failed (under 20 words, or over 30 % of the words in
    repeated windows) and kept (false where base_failed, else the verdict of the rules). A null or empty text has no
    words and so fails. Other columns of docs are ignored; repeated rows give repeated rows. One projection: no shuffle
    and no Python."""
    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), measures(text).alias("m")).select("doc_id", "m.*")
    failed = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
    return counted.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        f"({failed}) as base_failed", f"not ({failed}) and {verdict(rules)} as kept", "n_lines", "n_stop_words",
    )
