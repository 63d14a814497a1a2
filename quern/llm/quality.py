"""Quality rules: a threshold table compiled into one Spark projection.

:data:`RULES` names a metric and the range a good document has it in;
:func:`compile_rules` turns the table into the columns ``failed`` (names of
the broken rules, in the table's order) and ``keep``.  Everything is built-in
Spark SQL: no user function, no shuffle, one pass over ``doc_id`` and ``text``.

Metrics: length (words, mean word length), symbols (marks and capitals),
stop-words (share of the words, in four languages), variety (log of distinct
words over log of words) and lines (repeated lines, lines without an end mark).
Ratios that mean little for a few words are smoothed with constants instead of
being switched off below some length, so that one formula holds for all sizes:
:data:`SMOOTH` words are added to both sides of ``variety``, one stop-word in
twenty words to ``stop_word_ratio``, one ended line to ``open_line_ratio``.

Defined results: a null text counts as an empty one; an empty text has no
words, variety 1, stop-word ratio 1/20, 0 for the rest, and fails ``words`` and
``word_length`` alone; null ids and repeated rows are judged row by row;
doc_id keeps its type; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOP_WORDS = (
    "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which"
    " der die und das von zu mit sich des auf für ist im dem nicht ein eine als auch es den er an werden aus"
    " le la les de et des un une du en que qui dans pour pas sur au par est il ne se plus avec"
    " el los las y del se por con una su para es al lo como más o pero sus"
).split()
MARKS = "#*$%&|!~^_={}<>\\@"
PUNCTUATION = ".,;:!?\"()[]«»“”¿¡\t\r\n"
#: What a finished line ends with.
END_MARKS = ".!?:;…»”\"')]。！？"
#: Words added to the distinct and to all words of ``variety``.
SMOOTH = 10
#: (rule, metric, least, most)
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("words", "n_words", 1, None),
    ("word_length", "mean_word_length", 1.5, 20),
    ("marks", "mark_ratio", None, 0.08),
    ("capitals", "capital_ratio", None, 0.5),
    ("stop_words", "stop_word_ratio", 0.025, None),
    ("variety", "variety", 0.78, None),
    ("repeated_lines", "repeated_line_ratio", None, 0.6),
    ("open_lines", "open_line_ratio", None, 0.6),
)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id and the metrics of each row."""
    stops = ", ".join(_quoted(w) for w in sorted(set(STOP_WORDS)))
    flat = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    split = flat.selectExpr(
        "doc_id",
        "length(t) as n_chars",
        f"length(t) - length(translate(t, {_quoted(MARKS)}, '')) as marks",
        "length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ', '')) as capitals",
        f"filter(split(translate(lower(t), {_quoted(PUNCTUATION)}, {_quoted(' ' * len(PUNCTUATION))}), ' '), w -> w <> '') as words",
        "filter(split(replace(t, '\r', ''), '\\n'), l -> trim(l) <> '') as lines",
    )
    counted = split.selectExpr(
        "doc_id",
        "n_chars",
        "marks",
        "capitals",
        "size(words) as n_words",
        "length(array_join(words, '')) as letters",
        f"size(filter(words, w -> w in ({stops}))) as stops",
        "size(array_distinct(words)) as kinds",
        "size(lines) as n_lines",
        "size(array_distinct(lines)) as line_kinds",
        f"size(filter(lines, l -> instr({_quoted(END_MARKS)}, right(rtrim(l), 1)) = 0)) as open_lines",
    )
    return counted.selectExpr(
        "doc_id",
        "cast(n_chars as bigint) as n_chars",
        "cast(n_words as bigint) as n_words",
        "cast(n_lines as bigint) as n_lines",
        "case when n_words = 0 then 0d else round(letters / cast(n_words as double), 6) end as mean_word_length",
        "case when n_chars = 0 then 0d else round(marks / cast(n_chars as double), 6) end as mark_ratio",
        "case when letters = 0 then 0d else round(capitals / cast(letters as double), 6) end as capital_ratio",
        "round((stops + 1) / (n_words + 20d), 6) as stop_word_ratio",
        f"round(ln(kinds + {SMOOTH}) / ln(n_words + {SMOOTH}), 6) as variety",
        "case when n_lines = 0 then 0d else round(1 - line_kinds / cast(n_lines as double), 6) end as repeated_line_ratio",
        "round(open_lines / (n_lines + 1d), 6) as open_line_ratio",
    )


def _broken(metric: str, least: float | None, most: float | None) -> str:
    tests = [f"{metric} < {least}"] * (least is not None) + [f"{metric} > {most}"] * (most is not None)
    return "(" + " or ".join(tests) + ")"


def compile_rules(rules=RULES) -> list[str]:
    """SQL of the columns ``failed`` and ``keep``."""
    named = ", ".join(f"case when {_broken(m, a, b)} then '{name}' end" for name, m, a, b in rules)
    return [f"concat_ws(',', {named}) as failed", "not (" + " or ".join(_broken(m, a, b) for _, m, a, b in rules) + ") as keep"]


def assess(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row for each row of docs: its metrics, the rules it breaks, and whether to keep it."""
    return metrics(docs).selectExpr("*", *compile_rules(rules))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _duck(s: str) -> str:
    plain = "".join(c for c in s if c not in "\t\r\n")
    return "'" + plain.replace("'", "''") + "'" + "".join(f" || chr({ord(c)})" for c in s if c in "\t\r\n")


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    named = ", ".join(f"case when {_broken(m, a, b)} then '{name}' end" for name, m, a, b in RULES)
    broken = " or ".join(_broken(m, a, b) for _, m, a, b in RULES)
    marks, ends = MARKS.replace("'", "''"), END_MARKS.replace("'", "''")
    return f"""
with flat as (select doc_id, coalesce(text, '') as t from documents),
split as (select doc_id, length(t) as n_chars, length(t) - length(translate(t, '{marks}', '')) as marks,
  length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ', '')) as capitals,
  list_filter(string_split(translate(lower(t), {_duck(PUNCTUATION)}, '{" " * len(PUNCTUATION)}'), ' '), lambda w: w <> '') as words,
  list_filter(string_split(replace(t, chr(13), ''), chr(10)), lambda l: trim(l) <> '') as lines from flat),
counted as (select doc_id, n_chars, marks, capitals, len(words) as n_words, length(array_to_string(words, '')) as letters,
  len(list_filter(words, lambda w: w in ({stops}))) as stops, len(list_distinct(words)) as kinds,
  len(lines) as n_lines, len(list_distinct(lines)) as line_kinds,
  len(list_filter(lines, lambda l: instr('{ends}', right(rtrim(l), 1)) = 0)) as open_lines from split),
m as (select doc_id, n_chars::bigint as n_chars, n_words::bigint as n_words, n_lines::bigint as n_lines,
  case when n_words = 0 then 0 else round(letters / n_words::double, 6) end as mean_word_length,
  case when n_chars = 0 then 0 else round(marks / n_chars::double, 6) end as mark_ratio,
  case when letters = 0 then 0 else round(capitals / letters::double, 6) end as capital_ratio,
  round((stops + 1) / (n_words + 20)::double, 6) as stop_word_ratio, round(ln(kinds + {SMOOTH}) / ln(n_words + {SMOOTH}), 6) as variety,
  case when n_lines = 0 then 0 else round(1 - line_kinds / n_lines::double, 6) end as repeated_line_ratio,
  round(open_lines / (n_lines + 1)::double, 6) as open_line_ratio from counted)
select *, concat_ws(',', {named}) as failed, not ({broken}) as keep from m"""


ORACLE = _oracle()
