"""License scans: ordered signature rules, as DataFrame expressions only.

A text is reduced to its lower-cased words joined by single spaces.  Texts
without any gate word are done at once; elsewhere the keywords that occur
choose the rules, and only these rules' regular expressions run.  A detection
is an interval of words.  One that lies inside a detection of a rule of higher
priority, or of the same priority and no shorter, is suppressed; the labels of
the others are reported together with the labels of the base phrases, which
are counted on their own.

Nothing is shuffled, and no Python code runs on the executors.

Defined results: null and empty texts have no words, no labels and score 0; very
long texts are scanned whole; repeated rows, and rows with a null id, are
scanned one by one; equal intervals of equal priority are resolved by the
rules' order; an empty table gives no rows; further columns of the input,
whatever their names, are kept by ``scan_licenses`` (its own result columns
replace those of the same name).
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, spread_table
from .license_rules import GATES, RULES, Rule

BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
"""Phrases that are always counted, and their labels."""
PRIORITIES = sorted({r.priority for r in RULES})
#: What a text is worth whose best detection has this priority.
SCORE = {1: 0.2, 2: 0.5, 3: 0.75, 4: 0.9, 5: 1.0}

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"


def _spaces(c: Column) -> Column:
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def word_text(text: Column) -> Column:
    """`` w0 w1 ... wn ``: words between single spaces, one space alone if there are none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), _NOT_WORD, " ")


def _candidates(norm: Column, rules: list[Rule]) -> Column:
    """The rules whose keyword occurs."""
    told = [{"number": r.number, "priority": r.priority, "label": r.label, "keyword": r.keyword, "pattern": f"(?<= )({r.pattern})(?= )"} for r in rules]
    # one literal, folded once by the optimizer
    told = F.from_json(F.lit(json.dumps(told)), "array<struct<number: int, priority: int, label: string, keyword: string, pattern: string>>")
    return F.filter(told, lambda r: F.contains(norm, r["keyword"]))


def _spans(norm: Column, rule: Column) -> Column:
    """Detections of a rule: (begin, -end, -priority, number, label), in words. A pass marks matches, a pass over the words finds the marks, so the time is linear."""
    words = F.split(F.regexp_replace(norm, rule["pattern"], F.lit(_OPEN + "$1" + _CLOSE)), " ")
    # word i stands at i + 1, after the empty string before the first space
    begins = F.array_compact(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(_OPEN)), i - 1)))
    ends = F.array_compact(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit(_CLOSE)), i)))
    return F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("begin"), (-e).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["number"].alias("number"), rule["label"].alias("label")))


def found(norm: Column, rules: list[Rule] = RULES) -> Column:
    """All detections in order: by begin, longest first, highest priority first."""
    return F.array_sort(F.flatten(F.transform(_candidates(norm, rules), lambda r: _spans(norm, r))))


def surviving(detections: Column) -> Column:
    """struct(labels, n, best): distinct labels and number of the detections that no other suppresses, and the highest priority among them.

    In this order a detection lies inside an earlier one if and only if the
    earlier one ends no sooner, so the furthest end for each priority suffices.
    """
    slots = {p: f"upto{p}" for p in PRIORITIES}
    zero = F.struct(*(F.lit(-1).alias(s) for s in slots.values()), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        reach = F.greatest(*(F.when(priority <= p, acc[s]).otherwise(F.lit(-1)) for p, s in slots.items()))
        free = reach < end
        ends = [F.when(priority == p, F.greatest(acc[s], end)).otherwise(acc[s]).alias(s) for p, s in slots.items()]
        labels = F.when(free, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"])
        return F.struct(*ends, labels.alias("labels"), (acc["n"] + F.when(free, 1).otherwise(0)).alias("n"), F.when(free, F.greatest(acc["best"], priority)).otherwise(acc["best"]).alias("best"))

    return F.aggregate(detections, zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["n"].alias("n"), acc["best"].alias("best")))


def scan_licenses(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, base: list[tuple[str, str]] = BASE) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and n_detections."""
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]
    norm_col, parts, last, ruled, based = fresh([*docs.columns, *own], "norm", "parts", "last", "rules", "base")
    df = docs.drop(*(c for c in own if c != text_col)).withColumn(norm_col, word_text(F.col(text_col)))
    norm = F.col(norm_col)
    phrase = "(?<= )(?:" + "|".join(p for p, _ in base) + ")(?= )"
    none = F.lit(None).cast("struct<labels:array<string>,n:int,best:int>")
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(norm, F.lit(g))
    has_base = F.lit(False)
    for p, _ in base:
        has_base = has_base | F.contains(norm, F.lit(f" {p} "))
    df = df.withColumn(parts, F.when(has_base, F.split(norm, phrase))).withColumn(last, F.when(has_base, F.element_at(F.regexp_extract_all(norm, F.lit(phrase), F.lit(0)), -1)))
    df = df.withColumn(ruled, F.when(gate, surviving(found(norm, rules))).otherwise(none))
    n_words = _spaces(norm) - 1
    labels = F.array_compact(F.array(*(F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in base)))
    best = F.col(ruled)["best"]
    score = F.coalesce(F.element_at(F.create_map(*(x for p, s in SCORE.items() for x in (F.lit(p), F.lit(s)))), best), F.lit(0.0))
    df = (
        df.withColumn("n_words", n_words)
        .withColumn("n_base", F.coalesce(F.size(parts) - 1, F.lit(0)).cast("long"))
        .withColumn("first_word", F.when(has_base, _spaces(F.element_at(parts, 1)) - 1))
        .withColumn("last_word", F.when(has_base, F.col("n_words") - (_spaces(F.element_at(parts, -1)) - 1) - (_spaces(F.col(last)) + 1)))
        .withColumn(based, labels)
        .withColumn("base_labels", F.array_join(F.array_sort(F.array_distinct(based)), ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_union(based, F.coalesce(F.col(ruled)["labels"], F.array().cast("array<string>")))), ","))
        .withColumn("score", F.greatest(score, F.when(has_base, F.lit(SCORE[2])).otherwise(F.lit(0.0))))
        .withColumn("n_detections", F.coalesce(F.col(ruled)["n"], F.lit(0)).cast("long"))
    )
    return df.drop(norm_col, parts, last, ruled, based)


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """One row per detection, suppressed or not: doc_id, rule, label, priority, begin and end (in words)."""
    df = docs.select(F.col(id_col).alias("doc_id"), word_text(F.col(text_col)).alias("norm"))
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(F.col("norm"), F.lit(g))
    d = df.where(gate).select("doc_id", F.explode(found(F.col("norm"), rules)).alias("d"))
    return d.select("doc_id", F.col("d.number").alias("rule"), F.col("d.label").alias("label"), (-F.col("d.minus_priority")).alias("priority"), F.col("d.begin").alias("begin"), (-F.col("d.minus_end")).alias("end"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")
