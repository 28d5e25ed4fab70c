"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule has steps, the columns it computes, and a test that says when a document fails. `order_rules` measures on a sample which
documents each rule rejects and how long it takes in the executors, and puts next, time after time, the rule that rejects most of what the rules
before it leave, for its cost. `cascade` then applies them one after the other; the steps of a rule are computed only for documents that no
earlier rule rejected. The order never changes which documents stay.

`metrics` returns five steps for every document, so these are the cascade's first stage and always run, and the two base rules are
judged on them; the other rules follow in the measured order, and their further steps (`n_upper`, `n_lines`) are skipped for whatever is rejected before.

Words are runs of anything but ASCII white space. Defined results: null and blank texts have no words, no lines and fail `few_words`;
repeated rows are judged alike, each for itself; rules of equal worth keep their given order; a text is read as a whole, however long, and its words and windows
are arrays in its row; an empty table gives an empty result; columns of the input may have any names, also those of steps or with dots, since they
are numbered while steps stand beside them; but for one named like `out`, which the verdict replaces.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, numbered, place_of, words_of, written

#: Rows, about, on which cost and selectivity are measured, and the partitions they stand in.
SAMPLE_ROWS = 2000
SAMPLE_PARTS = 8
WINDOW = 5


class Rule(NamedTuple):
    name: str
    needs: tuple[str, ...]
    fails: str


#: Each step's SQL, over _q_text (never null), _q_words and the steps that it names. A step that a lambda reads stands in a projection
#: of its own, so that it is computed once a row.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "n_words": ((), "cast(size(_q_words) as bigint)"),
    "word_chars": ((), "cast(char_length(array_join(_q_words, '')) as bigint)"),
    "n_symbols": ((), "cast(regexp_count(_q_text, '[#*$%&|<>]') as bigint)"),
    "n_upper": ((), r"cast(regexp_count(_q_text, '\\p{Lu}') as bigint)"),
    "lines": ((), r"filter(split(_q_text, '\n'), x -> length(btrim(x, ' \t\n' || chr(11) || chr(12) || '\r')) > 0)"),
    "n_lines": (("lines",), "cast(size(_q_lines) as bigint)"),
    "n_dup_lines": (("lines",), "cast(size(_q_lines) - size(array_distinct(_q_lines)) as bigint)"),
    "hashes": ((), "transform(_q_words, x -> xxhash64(x))"),
    "windows": (
        ("hashes",),
        f"if(size(_q_hashes) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(_q_hashes) - {WINDOW}), i -> xxhash64("
        + ", ".join(f"get(_q_hashes, i + {k})" for k in range(WINDOW))
        + ")))",
    ),
    "placed": (
        ("windows",),
        "if(size(array_distinct(_q_windows)) = size(_q_windows), null, sort_array(transform(_q_windows, (h, i) -> struct(h as h, i as i))))",
    ),
    "again": (
        ("placed",),
        "sort_array(transform(filter(_q_placed, (p, k) -> p.h = get(_q_placed, k - 1).h or p.h = get(_q_placed, k + 1).h), p -> p.i))",
    ),
    "n_repeat_words": (
        ("again",),
        f"coalesce(aggregate(_q_again, named_struct('n', 0L, 'at', -{WINDOW}), (s, i) -> named_struct('n', s.n + least({WINDOW}, i - s.at), 'at', i), s -> s.n), 0L)",
    ),
}

#: Gopher-style limits. The first two are the base that any document has to pass.
RULES = (
    Rule("few_words", ("n_words",), "n_words < 10"),
    Rule("repeats", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("shouting", ("word_chars", "n_upper"), "10 * n_upper > 4 * word_chars"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("same_lines", ("n_lines", "n_dup_lines"), "2 * n_dup_lines > n_lines"),
)
BASE = ("few_words", "repeats")


def _chain(needs: tuple[str, ...]) -> list[str]:
    """The steps for needs, each after those that it reads."""
    out: list[str] = []
    for name in needs:
        out += [x for x in (*_chain(STEPS[name][0]), name) if x not in out]
    return out


def _over_steps(condition: str, names: tuple[str, ...]) -> str:
    for name in sorted(names, key=len, reverse=True):
        condition = condition.replace(name, f"_q_{name}") if f"_q_{name}" not in condition else condition
    return condition


def with_steps(df: DataFrame, needs: tuple[str, ...], alive: Column | None = None) -> DataFrame:
    """df and the steps for needs, as _q_<step>; null where alive isn't true."""
    for name in _chain(needs):
        if f"_q_{name}" not in df.columns:
            step = F.expr(STEPS[name][1])
            df = df.withColumn(f"_q_{name}", step if alive is None else F.when(alive, step))
    return df


def prepared(docs: DataFrame, text: Column) -> DataFrame:
    """docs, whose columns aren't named like steps, with the text and its words."""
    return docs.withColumn("_q_text", F.coalesce(text.cast("string"), F.lit(""))).withColumn("_q_words", words_of(F.col("_q_text")))


def failing(rule: Rule) -> Column:
    return F.expr(_over_steps(rule.fails, rule.needs))


def _seconds(df: DataFrame, tests: list[Column]) -> float:
    """Seconds that tests take in the executors: of every partition from its first row to its last, by the executor's clock, the lesser of two runs."""
    clock = F.expr("cast(reflect('java.lang.System', 'nanoTime') as bigint)")
    spent = df.withColumn("_q_now", clock).groupBy(F.spark_partition_id().alias("part"))
    query = spent.agg((F.max("_q_now") - F.min("_q_now")).alias("ns"), *[F.count_if(t).alias(f"t{k}") for k, t in enumerate(tests)])
    return min(query.agg(F.coalesce(F.sum("ns"), F.lit(0))).first()[0] for _ in range(2)) / 1e9


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules, each time the one with most rejections per second of those that are left, on a sample of about so many rows.

    The sample is a share of the rows, drawn in every partition, so no more than about so many texts are shuffled, whatever the table's size.
    """
    texts = docs.select(column(text_col).cast("string").alias("text"))
    total = texts.count()
    sample = written(texts.sample(min(1.0, rows / max(total, 1)), 7).repartition(SAMPLE_PARTS), "sample")
    base = prepared(sample, F.col("text"))
    failed = F.array(*[F.coalesce(failing(r), F.lit(False)) for r in rules])
    every = with_steps(base, tuple(n for r in rules for n in r.needs))
    seen = every.groupBy(failed.alias("failed")).agg(F.count("*").alias("n")).collect()  # 2 ** len(rules) rows at most
    floor = _seconds(base, [F.size("_q_words") < 0])
    cost = [max(_seconds(with_steps(base, r.needs), [failing(r)]) - floor, 1e-4) for r in rules]
    left, out = list(range(len(rules))), []
    while left:
        k = max(left, key=lambda k: (sum(r["n"] for r in seen if r["failed"][k]) / cost[k], -k))
        seen = [r for r in seen if not r["failed"][k]]
        left.remove(k)
        out.append(rules[k])
    return out


def cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text", out: str = "rejected_by") -> DataFrame:
    """docs and column out, the first of rules in this order that a document fails, or null."""
    df = prepared(numbered(docs), F.col(place_of(docs, text_col))).withColumn("_q_rejected", F.lit(None).cast("string"))
    for rule in rules:
        df = with_steps(df, rule.needs, F.col("_q_rejected").isNull())
        df = df.withColumn("_q_rejected", F.coalesce("_q_rejected", F.when(failing(rule), rule.name)))
    # The second branch is never taken. It only keeps filters on the verdict from being pushed below, where each would hold all steps written out.
    verdict = F.coalesce("_q_rejected", F.when(F.spark_partition_id() < 0, "none"))
    return df.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() != out.lower()], verdict.alias(out))


def metrics(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base metrics of every document and the cascade's verdict over them."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    slim = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    df = with_steps(prepared(slim, F.col("text")), base)
    failed = F.lit(False)
    for rule in RULES:
        if rule.name in BASE:
            failed = failed | failing(rule)
    df = df.withColumn("_q_failed", failed).withColumn("_q_rejected", F.when(F.col("_q_failed"), "base"))
    for rule in rules:
        if rule.name not in BASE:
            df = with_steps(df, rule.needs, F.col("_q_rejected").isNull())
            df = df.withColumn("_q_rejected", F.coalesce("_q_rejected", F.when(failing(rule), rule.name)))
    return df.select(
        "doc_id",
        *[F.col(f"_q_{c}").alias(c) for c in base],
        F.col("_q_failed").alias("base_failed"),
        F.col("_q_rejected").isNull().alias("kept"),
    )
