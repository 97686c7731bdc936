import itertools
import random
import re

import duckdb
import pytest

from quarryline.llm import licenses, oracles
from quarryline.llm.license_rules import GATES, RULES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    norm = " " + "".join(x + " " for x in w)
    places, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                base.add(label)
    found = []
    for r in RULES:
        if r.keyword in norm:
            found += [(norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" "), r) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm)]

    def beaten(d):
        for e in found:
            if e is d or e[0] > d[0] or e[1] < d[1]:
                continue
            rank = lambda x: (x[2].priority, x[1] - x[0], -x[2].number)
            if rank(e) > rank(d):
                return True
        return False

    free = [d for d in found if not beaten(d)]
    best = max((d[2].priority for d in free), default=0)
    score = max(licenses.SCORE.get(best, 0.0), 0.5 if places else 0.0)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[2].label for d in free})), score, len(free))


def test_rules():
    assert len(RULES) > 200 and len({r.pattern for r in RULES}) > 200
    for r in RULES:
        assert any(g in r.keyword for g in GATES), r
        plain = re.sub(r"\(\?:[^()]*\)[?*]", "", r.pattern)
        assert re.compile(r.pattern) and r.keyword.strip() == r.keyword, plain


def forms(tree):
    """All texts of a parsed pattern; what may repeat stands as often as it must, and once more."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            own = [chr(arg)]
        elif name == "IN":
            own = [chr(v) for _, v in arg]
        elif name in ("ANY", "NOT_LITERAL"):
            own = ["x"]
        elif name == "SUBPATTERN":
            own = forms(arg[3])
        elif name == "BRANCH":
            own = [f for branch in arg[1] for f in forms(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, what = arg
            own = ["".join(x) for n in range(least, min(most, least + 1) + 1) for x in itertools.product(forms(what), repeat=n)]
        else:
            raise AssertionError(name)
        out = [a + b for a in out for b in own]
    return out


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.number}-{r.label}")
def test_every_form_has_keyword_and_gate(rule):
    every = forms(re._parser.parse(rule.pattern))
    assert all(re.fullmatch(rule.pattern, f) for f in every)
    assert [f for f in every if rule.keyword not in f or not any(g in f for g in GATES)] == []


def test_forms_without_the_first_keyword(spark):
    texts = {"llama 3 community license": "llama", "llama 3 1 community license": "llama", "png reference library license": "libpng", "postgresql licence": "postgresql", "open data commons database license": "odbl-1.0", "w3c software and notice and document license": "w3c", "unicode inc license": "unicode", "beerware license": "beerware", "open rail": "openrail"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["text"]: r["labels"] for r in licenses.scan_licenses(df).collect()} == texts


def test_against_brute_force(spark):
    r = random.Random(0)
    seeds = ["MIT License", "mit license", "Apache License, Version 2.0", "GNU General Public License v3", "general public license", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-2.0-or-later", "All rights reserved.", "Creative Commons Attribution 4.0 International License", "BSD 3-Clause License", "word", "Straße", "mit", "license", "cc by nc 4 0", "you may not use this file except in compliance with the License"]
    texts = [" ".join(r.choice(seeds) for _ in range(r.randint(0, 12))) for _ in range(150)]
    texts += [None, "", " ... ", "MIT license MIT license mit licenses", "x" * 5000 + " MIT License", "mit license " * 2000, "no-license", "\x01mit\x02license"]
    texts += [f"{k} {r.keyword} z" for k, r in enumerate(RULES)]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    out = licenses.scan_licenses(df)
    got = {x["doc_id"]: x for x in out.collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert tuple(x[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")) == brute(t), t


def test_sql_against_brute_force():
    """The SQL's suppression by definition and its edges of words, on every form of every rule."""
    r = random.Random(1)
    every = [f for rule in RULES for f in forms(re._parser.parse(rule.pattern))]
    texts = [f"É {a} ß, {b}\n{b} {c}é" for a, b, c in zip(every, r.sample(every, len(every)), r.sample(every, len(every)), strict=True)]
    texts += [None, "", "all rights reserved all rights reserved", "MIT License MIT license\x01MIT\x02license", "émit license", "mit licenseé", "GPLv2 gplv2", "copyright Ünïcode all rights reserved"]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = {x[0]: x[1:] for x in c.sql(oracles.LICENSES).fetchall()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != brute(t)] == []


def test_clashing_names_and_long_texts(spark):
    """Working columns do not disturb those of the input; null ids, repeated rows, a text of 2 MB, an empty table."""
    names = ["norm", "parts", "last", "rules", "base", "__norm", "__rules", "Norm_"]
    texts = [(None, "MIT License"), (1, "MIT License"), (1, "MIT License"), (2, None), (3, "no words " * 220_000 + "Apache License")]
    df = spark.createDataFrame([(i, t, *names) for i, t in texts], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = licenses.scan_licenses(df)
    rows = out.collect()
    assert out.columns[: 2 + len(names)] == df.columns and all([r[n] for n in names] == names for r in rows)
    assert sorted(((r["doc_id"], r["n_words"], r["last_word"]) for r in rows), key=repr) == sorted([(None, 2, 0), (1, 2, 0), (1, 2, 0), (2, 0, None), (3, 440_002, 440_000)], key=repr)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_detections_and_plan(spark):
    df = spark.createDataFrame([(1, "under the Apache License, Version 2.0"), (2, "nothing")], "doc_id long, text string")
    rows = licenses.detections(df).collect()
    assert {(r["label"], r["begin"], r["end"]) for r in rows} >= {("apache-2.0", 1, 7), ("apache", 2, 4)}
    plan = licenses.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert licenses.scan_licenses(df.limit(0)).count() == 0
