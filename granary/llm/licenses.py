"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line of the text, or a run of lines between blank ones (lines of comment marks alone are blank), so that
notices broken over lines are found: runs are read in overlapping windows of WINDOW words, and a template of any line
breaks stands whole in one. For each licence family a logistic regression over the word unigrams and bigrams of a
paragraph is trained (numpy, on the driver; L1 keeps few weights) from the templates below, shortened and embedded in
other words, against known negatives: generic sentences about licences, and of a bounded sample of at most about MAX_NEGATIVE
paragraphs of the corpus those that a rule (`known_negative`) says are none, as they share little with any template. The
unknown class is calibrated for each family by itself: a paragraph belongs to a family only if its probability is beyond
THRESHOLD and beyond that of TOLERATED of the negatives of the calibration half. A template comparison confirms: the share of the template's word
bigrams that the paragraph has must reach CONFIRM, and where other versions or siblings of a licence have nearly the same
words, the paragraph must have the words in NEEDS, the version right behind the name, and none of NEGATED before it. BSD-3-Clause isn't
confirmed in texts that have its second condition but not its third, or the advertising clause, as those are notices of two or
four clauses; nor MIT in texts that grant its rights without its conditions.

All n-grams of the templates are features, however common in the corpus. A family's score can't pass the threshold by n-grams
whose positive weights sum up to too little; the commonest that do are no triggers, and only lines and windows with one of
the other n-grams of positive weight are scored. This drops no case.

Defined results: null and empty texts have no paragraphs that count, and no licence; ties between families go to the
first in alphabetical order; repeated rows each give their row. n_paragraphs counts lines; n_license counts lines that
belong to a family, and runs that do though none of their lines does.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share_order

MAX_NEGATIVE = 3_000
L1, STEPS, RATE = 0.002, 600, 1.0
THRESHOLD, CONFIRM = 0.5, 0.8
#: Part of the negatives that a threshold lies above; the others may be notices that the rule didn't see.
TOLERATED = 0.98
#: From this part or number of a template's bigrams, or this part of its own in one template, a paragraph is no known negative.
OVERLAP, MANY, OWN = 0.25, 5, 0.4
#: A word that at most this part of the sample's paragraphs have may stand for an n-gram in the search for triggers.
RARE = 0.01
# Short notices and opening paragraphs of well-known licences.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "Licensed under AGPLv3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "License: Apache 2.0", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-4-Clause": ["All advertising materials mentioning features or use of this software must display the following acknowledgement", "SPDX-License-Identifier: BSD-4-Clause"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0", "Licensed under GPLv2."],
    "GPL-3.0": ["GNU General Public License version 3 or later", "SPDX-License-Identifier: GPL-3.0", "Licensed under GPLv3.", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["MIT licensed.", "SPDX-License-Identifier: MIT", "Licensed under the MIT License.", "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "MIT-0": ["Released under the MIT No Attribution License.", "SPDX-License-Identifier: MIT-0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
# What tells versions and siblings apart, in normal form between spaces.
NEEDS = {
    "AGPL-3.0": " (gnu affero general public license (as published by the free software foundation )?(either )?(version )?3|agpl(v| v)?( version)? ?3( 0)?) ",
    "Apache-2.0": " apache (license )?(version )?2 0 ",
    "BSD-3-Clause": " (bsd 3 clause|redistribution and use in source and binary forms) ",
    "BSD-4-Clause": " (bsd 4 clause|all advertising materials mentioning features or use of this software) ",
    "CC-BY-4.0": " (by|attribution) 4 0 ",
    "CC-BY-NC-4.0": " (by nc|attribution noncommercial) 4 0 ",
    "CC-BY-SA-4.0": " (by sa|attribution sharealike) 4 0 ",
    "CC0-1.0": " (cc0( 1 0)?|waived all copyright and related or neighboring rights) ",
    "GPL-2.0": " ((?<!affero |lesser |library )general public license (as published by the free software foundation )?(either )?(version |v )?2|(?<![al])gpl(v| v)? ?2( 0)?) ",
    "GPL-3.0": " ((?<!affero |lesser |library )general public license (as published by the free software foundation )?(either )?(version |v )?3|(?<![al])gpl(v| v)? ?3( 0)?) ",
    "ISC": " (isc( license)?|permission to use copy modify and or distribute this software for any purpose) ",
    "LGPL-2.1": " (gnu lesser general public license (as published by the free software foundation )?(either )?(version )?2 1|lgpl(v| v)? ?2 1) ",
    "LGPL-3.0": " (gnu lesser general public license (as published by the free software foundation )?(either )?(version )?3|lgpl(v| v)? ?3( 0)?) ",
    "MIT": " (mit(?! 0 | no attribution)|permission is hereby granted free of charge) ",
    "MIT-0": " mit (0|no attribution) ",
    "MPL-2.0": " mozilla public license v 2 0 | mpl 2 0 ",
}
# Words before a name that say that it isn't the licence.
NEGATED = " (not|never|no longer|isn t|rather than|instead of) ((be|been|currently|being) )?((re)?(licensed|released|distributed|available|covered|published) )?(under )?"
SECOND_CONDITION, THIRD_CONDITION = "redistributions in binary form must reproduce", "neither the name"
#: A text with the first words of its last clause but not the next is no MIT notice, but one without the conditions.
NO_CONDITIONS, CONDITIONS = "furnished to do so", "subject to the following conditions"
ADVERTISING = "all advertising materials mentioning features"
# Sentences about licences that name none.
GENERIC = ["All rights reserved.", "Please read the license terms before use.", "A license is required to drive.", "This work is under review.", "Released last year to the public.", "The driver's license was lost.", "He is licensed to sell cars.", "Version 2.0 of the plan was released.", "The software is free of charge.", "This program is shown on television.", "The general public is welcome.", "Terms and conditions apply.", "The source code is not available.", "You may not use this file."]
#: Words of a window and from one to the next: one and a half of the longest template's length stand whole in a window.
LONGEST = max(len(re.findall("[a-z0-9]+", t.lower())) for t in sum(TEMPLATES.values(), []))
WINDOW, STRIDE = 2 * LONGEST, LONGEST // 2
#: What stands between runs of lines, and words that mark a comment at the start of a line.
BLANK, MARK = r"\n[^\p{L}\p{N}]*\n", r"(?m)^[^\p{L}\p{N}\n]*(?:dnl|rem)\b"


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip(" ")


def normal_column(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def windows(run: Column) -> Column:
    """The windows of a run of lines in lower case; none for a single line."""
    words = F.array(F.split(normal_column(F.regexp_replace(run, MARK, " ")), " "))
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0)) + (STRIDE - 1), F.lit(STRIDE))
    cut = F.flatten(F.transform(words, lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i + 1, WINDOW), " "))))
    return F.when(F.contains(run, F.lit("\n")), cut).otherwise(F.array().cast("array<string>"))


def grams(text: str) -> set[str]:
    words = normal(text).split(" ")
    return {w for w in words if w} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def bigrams(text: str) -> list[str]:
    words = normal(text).split(" ")
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


TEMPLATE_BIGRAMS = [set(bigrams(t)) for t in sum(TEMPLATES.values(), [])]


def known_negative(text: str) -> bool:
    """Whether a paragraph shares too little with each template to be a notice or a line of one."""
    own = set(bigrams(text))
    return all(len(own & t) < min(OVERLAP * len(t), MANY) and (len(own & t) < 2 or len(own & t) < OWN * len(own)) for t in TEMPLATE_BIGRAMS)


def fit(negatives: list[str], seed: int = 7) -> tuple[list[str], dict[str, tuple[float, np.ndarray]], dict[str, float]]:
    """n-grams, bias and weights of each family, and its threshold."""
    rng = np.random.default_rng(seed)
    negatives = sorted(filter(known_negative, set(negatives))) + GENERIC * 5
    rows, families = [grams(t) for t in negatives], [""] * len(negatives)
    filler = [w for t in negatives[:200] for w in normal(t).split(" ")] or ["text"]
    for family, texts in sorted(TEMPLATES.items()):
        for text in texts:
            words = normal(text).split(" ")
            for n in range(18):
                most = 6 if n < 12 else max((WINDOW - len(words)) // 2, 6)  # as in a line, or as in a window
                around = [rng.choice(filler, rng.integers(0, most)).tolist() for _ in range(2)] if n else [[], []]
                kept = [w for w in words if n < 4 or rng.random() > 0.05]
                rows.append(grams(" ".join([*around[0], *kept, *around[1]])))
                families.append(family)
    vocabulary = sorted(set().union(*(grams(t) for t in sum(TEMPLATES.values(), []))))
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, row in enumerate(rows):
        x[i, [index[g] for g in row if g in index]] = 1
    labels = np.array(families)
    tests = (np.arange(len(rows)) % 2 == 0) & (labels == "")
    model, thresholds = {}, dict.fromkeys(TEMPLATES, THRESHOLD)
    for family in sorted(TEMPLATES):
        y = (labels == family).astype(float)
        use = ~tests
        share = np.where(y[use] > 0, 0.5 / max(y[use].sum(), 1), 0.5 / max((1 - y[use]).sum(), 1))
        # equal rows count once, with their weight: nearly all paragraphs have none of the n-grams
        alike, back = np.unique(np.column_stack((y[use], x[use])), axis=0, return_inverse=True)
        share, truth, alike = np.bincount(back.ravel(), share), alike[:, 0], alike[:, 1:]
        w, bias = np.zeros(len(vocabulary)), -2.0
        for _ in range(STEPS):  # proximal gradient steps
            e = share * (1 / (1 + np.exp(-(alike @ w + bias))) - truth)
            w -= RATE * (alike.T @ e)
            w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1, 0)
            bias = min(bias - RATE * e.sum(), -1.0)
        model[family] = (float(bias), w)
        if tests.any():
            p = 1 / (1 + np.exp(-(x[tests] @ w + bias)))
            thresholds[family] = min(max(THRESHOLD, float(np.quantile(p, TOLERATED, method="lower"))), 0.99)
    return vocabulary, model, thresholds


def needed(weights: dict[str, float], room: float, common: Counter) -> set[str]:
    """n-grams of positive weight of which a paragraph must have one if its weights are to sum up to more than room."""
    out = {g for g, w in weights.items() if w > 0}
    for g in sorted(out, key=lambda g: (-common[g], g)):
        if weights[g] <= room:
            room -= weights[g]
            out.discard(g)
    return out


def scan(docs: DataFrame, max_negative: int = MAX_NEGATIVE) -> DataFrame:
    """doc_id, n_paragraphs, n_license, licenses, license, score and confirmed of every row of docs."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    total = texts.count()
    runs = F.split(F.lower("text"), BLANK)
    some = texts.where(share_order("text") < max_negative / 2 / max(total, 1)).select(F.explode(F.concat(lines, F.flatten(F.transform(runs, windows)))).alias("p"))
    sample = some.where(share_order("p") < 0.5).select("p").distinct().orderBy(share_order("p"), "p").limit(max_negative)
    sampled = [r["p"] for r in sample.collect()]
    vocabulary, model, thresholds = fit(sampled)

    # of each n-gram that is needed the word that is rarest in the sample, or all of it if none is rare
    common = Counter(g for p in sampled for g in grams(p))
    room = {f: float(np.log(thresholds[f] / (1 - thresholds[f]))) - bias - 1e-6 for f, (bias, _) in model.items()}
    triggering = set().union(*(needed(dict(zip(vocabulary, w.tolist(), strict=True)), room[f], common) for f, (_, w) in model.items()))
    rarest = {g: min(g.split(" "), key=lambda v: (common[v], -len(v), v)) for g in triggering}
    triggers = {w if common[w] <= RARE * len(sampled) else g for g, w in rarest.items()}
    triggers = sorted(g.replace(" ", "[^a-z0-9]+") for g in triggers if " " not in g or not triggers.intersection(g.split(" ")))
    trigger = f"(?<![a-z0-9])(?:{'|'.join(triggers)})(?![a-z0-9])"
    # lines and windows of the runs that have a trigger, each with the number of its run
    docs = texts.withColumn("_runs", F.filter(runs, lambda r: r.rlike(trigger)))
    hit = lambda parts: F.filter(parts, lambda p: p.rlike(trigger))
    entry = lambda p, i, line: F.struct(p.alias("p"), i.alias("run"), F.lit(line).alias("line"))
    entries = lambda r, i: F.concat(
        F.transform(hit(F.split(r, "\n")), lambda p: entry(normal_column(p), i, True)), F.transform(hit(windows(r)), lambda p: entry(p, i, False))
    )
    docs = docs.withColumn("_hits", F.flatten(F.transform("_runs", entries)))

    # one SQL expression: thousands of calls for its parts would take far longer than the scan of a small table
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    families = sorted(TEMPLATES)

    def score(family: str) -> str:
        bias, w = model[family]
        parts = [f"if(contains(concat(' ', h.p, ' '), {quoted(f' {vocabulary[i]} ')}), {float(w[i])!r}D, 0D)" for i in np.flatnonzero(w)]
        return f"1 / (1 + exp(-({bias!r}D + {' + '.join(parts) or '0D'})))"

    def shared(family: str) -> str:
        each = [f"({' + '.join(f"""if(contains(concat(' ', e.p, ' '), {quoted(f' {b} ')}), 1, 0)""" for b in bigrams(t))}) / {len(bigrams(t))}" for t in TEMPLATES[family]]
        return f"greatest({', '.join(each)})" if len(each) > 1 else each[0]

    scores, limits = ", ".join(map(score, families)), ", ".join(f"{thresholds[f]!r}D" for f in families)
    best = f"transform(array({scores}), (s, i) -> struct(s > get(array({limits}), i) as over, s as score, -i as at))"
    docs = docs.withColumn("_each", F.expr(f"transform(_hits, h -> struct(h.p as p, h.run as run, h.line as line, array_max({best}) as best))"))
    docs = docs.withColumn("_known", F.filter("_each", lambda e: e["best"]["over"]))
    cases = " ".join(f"when {-i} then {shared(f)}" for i, f in enumerate(families))
    names = ", ".join(map(quoted, families))
    needs = " ".join(f"when {-i} then rlike(concat(' ', e.p, ' '), {quoted(NEEDS[f])})" for i, f in enumerate(families) if f in NEEDS)
    told = f"(case e.best.at {needs} else true end) and not rlike(concat(' ', e.p, ' '), {quoted(NEGATED + '(the |an? )?(terms of the )?(gnu |mit|apache|bsd|cc|isc|mozilla|creative|gpl|lgpl|agpl)')})"
    told += f" and not (e.best.at = {-families.index('BSD-3-Clause')} and _other_clauses) and not (e.best.at = {-families.index('MIT')} and _no_conditions)"
    has = lambda words: F.lower("text").rlike(words.replace(" ", "[^a-z0-9]+"))
    some = lambda c: F.when(F.size("_known") > 0, c).otherwise(F.lit(False))
    docs = docs.withColumn("_other_clauses", some((has(SECOND_CONDITION) & ~has(THIRD_CONDITION)) | has(ADVERTISING)))
    docs = docs.withColumn("_no_conditions", some(has(NO_CONDITIONS) & ~has(CONDITIONS)))
    found = f"struct((case e.best.at {cases} end) >= {CONFIRM}D and {told} as confirmed, e.best.score as score, e.best.at as at, get(array({names}), -e.best.at) as family, e.run as run, e.line as line)"
    docs = docs.withColumn("_found", F.expr(f"transform(_known, e -> {found})"))
    docs = docs.withColumn("_top", F.array_max("_found"))
    sure = F.filter("_found", lambda e: e["confirmed"])
    of = lambda line: F.transform(F.filter("_found", lambda e: e["line"] == F.lit(line)), lambda e: e["run"])
    n_found = F.size(of(True)) + F.size(F.array_except(of(False), of(True)))
    return docs.select(
        "doc_id", F.size(lines).cast("long").alias("n_paragraphs"), n_found.cast("long").alias("n_license"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda e: e["family"]))), ",").alias("licenses"),
        F.when(F.col("_top.confirmed"), F.col("_top.family")).alias("license"), F.coalesce("_top.score", F.lit(0.0)).alias("score"), F.coalesce("_top.confirmed", F.lit(False)).alias("confirmed"),
    )
