"""Licence scans in DataFrame functions: a paragraph classifier, confirmed by comparison with templates.

The model is a multinomial logistic regression over the presence of word uni- and bigrams, sparse: only
those of the texts below have weights, found by their hashes.  Its classes are the families of the
templates, other licences (``unknown``) and no licence at all.  It is fitted on the driver to variations of
the texts below, a bounded number whatever the input; its temperature and the probability from which a
family is told are set on two further sets, which hold licences that the fit has not seen.

A paragraph is a block of lines between blank ones.  It is scored whole, in windows of ``WINDOW`` words that
overlap by half, and so is each of its lines, so a notice is found broken over lines, on a line of its own
and in the midst of a long one.  Nothing is skipped but windows whose weights can't outdo "no licence",
whatever the class.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bound, kept_columns, own_names, quoted

# Notices and opening sentences of public licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
        "Released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "All rights reserved worldwide.",
        "(c) the authors, all rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Sentences about licences, rights and permission that grant none.
HARMLESS = [
    "The driver's license was renewed in the spring.",
    "Permission denied when opening the file.",
    "She asked for permission to leave the room.",
    "The museum is open to the public domain experts said.",
    "The lecture covered copyright law and its history.",
    "He has a licence to fish in the lake.",
    "The warranty of the washing machine expired.",
    "The library lends books under several conditions.",
    "Civil rights and public policy were reserved for the next chapter.",
    "All seats are reserved for guests.",
    "The Apache helicopter landed near the base.",
    "A professor at MIT published the results.",
    "The general public was invited to the free concert.",
    "The redistribution of wealth is debated in public.",
    "This software is slow and the license server is down.",
    "Please include the version number in all reports.",
]
# Notices of other public licences, for the class of unknown ones: those that it is fitted to,
# and those that only calibration and the threshold see.
OTHERS: dict[str, list[str]] = {
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed under the zlib License."],
    "artistic": ["This package may be redistributed and modified under the terms of the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License.", "Licensed under the Common Development and Distribution License, version 1.1."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "osl": ["Licensed under the Open Software License version 3.0."],
    "cecill": ["This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software."],
    "sleepycat": ["Redistributions in any form must be accompanied by information on how to obtain complete source code for the software."],
}
OTHERS_SET: dict[str, list[str]] = {
    "eupl": ["Licensed under the EUPL, Version 1.2, or later versions approved by the European Commission.", "SPDX-License-Identifier: EUPL-1.2"],
    "ms-pl": ["This code is licensed under the Microsoft Public License."],
    "psf": ["Licensed to the community under the Python Software Foundation License, version 2."],
    "w3c": ["This work is distributed under the W3C Software License in the hope that it will be useful."],
    "afl": ["Licensed under the Academic Free License version 3.0."],
}
# What licences are called, by family; other licences as above.
NAMES: dict[str, list[str]] = {
    "mit": ["MIT License", "MIT license (Expat)", "MIT"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL", "GPL-3.0-or-later", "GPL-2.0-only"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v2.1", "GNU LGPL", "LGPL-3.0-or-later"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL", "AGPL-3.0-or-later"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-3-Clause"],
    "mpl": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "isc": ["ISC License", "ISC"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "public-domain": ["CC0 1.0 Universal public domain dedication", "Unlicense", "CC0-1.0"],
}
OTHER_NAMES = ["zlib License", "Artistic License 2.0", "Common Development and Distribution License", "CDDL-1.1", "Boost Software License 1.0", "BSL-1.0", "SIL Open Font License 1.1", "Open Software License 3.0", "CeCILL license", "Sleepycat License", "Eiffel Forum License", "Open Data Commons Open Database License", "Reciprocal Public License", "Nokia Open Source License"]
OTHER_NAMES_SET = ["EUPL, Version 1.2", "Microsoft Public License", "Python Software Foundation License", "W3C Software License", "Academic Free License 3.0", "Common Public License 1.0", "Intel Open Source License", "Apple Public Source License"]
#: How a licence is named; each name in each.
PATTERNS = ["Licensed under the {}.", "This project is released under the terms of the {}.", "Distributed under the {}; see the LICENSE file.", "License: {}", "SPDX-License-Identifier: {}", "This work is licensed under a {}.", "The source code is available under the {}."]
NONE, UNKNOWN = "none", "unknown"
HASHES, VARIATIONS, STEPS = 1 << 16, 12, 200
#: Words of a window, and the share of trigrams that a template and a window must share.
WINDOW, CONFIRMED = 80, 0.6
#: The most of what is told on the set for the threshold that may be wrong.
WRONG = 0.02
_WORD = r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"
_BLANK = r"\n[ \t\r]*\n[ \t\r\n]*"


class Model(NamedTuple):
    classes: list[str]  # none, unknown, then the families
    index: np.ndarray  # a gram's row of weights by its hash, -1 without one
    weights: np.ndarray  # grams x classes
    bias: np.ndarray
    temperature: float
    least: float  # the probability from which a family is told


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _signed_hash(s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _grams(words: list[str]) -> set[int]:
    """Hashes of the uni- and bigrams."""
    return {_signed_hash(g) % HASHES for g in {*words, *map(" ".join, zip(words, words[1:], strict=False))}}


Labelled = tuple[list[list[str]], list[int]]
Notices = list[tuple[int, str]]


def notices(templates: dict[str, list[str]] = TEMPLATES, others: dict[str, list[str]] = OTHERS, other_names: list[str] = OTHER_NAMES, patterns: list[str] = PATTERNS) -> Notices:
    """(class, text): class 1 is unknown, the rest the families of ``TEMPLATES`` in their order."""
    order = list(TEMPLATES)
    told = [(order.index(f) + 2, t) for f, own in templates.items() for t in own] + [(1, t) for own in others.values() for t in own]
    named = [(order.index(f) + 2, name) for f, own in NAMES.items() for name in own] + [(1, name) for name in other_names]
    return told + [(c, p.format(name)) for c, name in named for p in patterns]


def variations(seed: int, given: Notices | None = None, n: int = VARIATIONS) -> Labelled:
    """Words and class of varied notices (words lost, cut short, other words around) and of no licence, class 0."""
    r = random.Random(seed)
    plain = sorted({w for t in HARMLESS for w in _words(t)})

    def filler(k: int) -> list[str]:
        return [r.choice(plain) if r.random() < 0.3 else "".join(r.choices("aeinorstlhd", k=r.randint(2, 9))) for _ in range(k)]

    around = lambda: filler(r.choice((0, 0, 3, 15, 40)))
    texts, classes = [], []
    for c, template in given or notices():
        words = _words(template)
        for i in range(n if len(words) > 12 else max(1, n // 3)):
            kept = words
            if i and len(words) > 12:
                kept = [w for w in words if r.random() > 0.08]
                size = max(4, round(len(kept) * r.uniform(0.7, 1)))
                at = r.randint(0, max(0, len(kept) - size))
                kept = kept[at : at + size]
            texts.append(around() + kept + around())
            classes.append(c)
    pool = sorted({w for own in TEMPLATES.values() for t in own for w in _words(t)})
    for i in range(len(texts) // 2):
        base = _words(r.choice(HARMLESS)) if i % 2 else r.choices(pool, k=r.randint(1, 4))
        texts.append(around() + base + around())
        classes.append(0)
    return texts, classes


def _probabilities(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def scores(model: Model, texts: list[list[str]]) -> np.ndarray:
    out = np.tile(model.bias, (len(texts), 1))
    for row, words in zip(out, texts, strict=True):
        for g in _grams(words):
            if model.index[g] >= 0:
                row += model.weights[model.index[g]]
    return out


def fit(fitted: Labelled, calibrated: Labelled, judged: Labelled, vocabulary: list[list[str]]) -> Model:
    """Fit to one set, set the temperature on another and the threshold on a third; ``vocabulary`` says which grams have weights."""
    classes = [NONE, UNKNOWN, *TEMPLATES]
    known = sorted(set().union(*map(_grams, vocabulary)))
    index = np.full(HASHES, -1, dtype=np.int32)
    index[known] = np.arange(len(known))
    texts, truth = fitted
    x = np.zeros((len(texts), len(known) + 1), dtype=np.float32)
    x[:, -1] = 1
    for row, words in zip(x, texts, strict=True):
        row[[index[g] for g in _grams(words) if index[g] >= 0]] = 1
    y, w = np.eye(len(classes), dtype=np.float32)[truth], np.zeros((len(known) + 1, len(classes)), dtype=np.float32)
    for _ in range(STEPS):
        w -= 4.0 * (x.T @ (_probabilities(x @ w) - y) / len(x) + 1e-4 * w)
    w = w.astype(np.float64)
    model = Model(classes, index, w[:-1], w[-1], 1.0, 0.5)
    held, truth = scores(model, calibrated[0]), np.array(calibrated[1])
    loss = lambda t: -np.log(_probabilities(held / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = float(min((0.25 * 1.15**i for i in range(30)), key=loss))
    p, truth = _probabilities(scores(model, judged[0]) / temperature), np.array(judged[1])
    told = p.argmax(1) > 1
    sure, right = p.max(1)[told], (p.argmax(1) == truth)[told]
    by = np.argsort(-sure)
    wrong = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
    good = np.flatnonzero(wrong <= WRONG)
    least = float(sure[by][good[-1]]) if len(good) else 0.99
    return model._replace(temperature=temperature, least=min(0.99, max(0.5, least)))


def _vocabulary(given: Notices) -> list[list[str]]:
    return [_words(t) for _, t in given] + [_words(t) for t in HARMLESS]


@lru_cache(maxsize=1)
def train(seed: int = 11) -> Model:
    """The model of all notices.  The same every time."""
    unseen = notices(others=OTHERS | OTHERS_SET, other_names=OTHER_NAMES + OTHER_NAMES_SET)
    return fit(variations(seed), variations(seed + 1, unseen, 6), variations(seed + 2, unseen, 6), _vocabulary(notices()))


def reliability(p: np.ndarray, truth: np.ndarray, bins: int = 10) -> float:
    """Expected calibration error: how far, on average, the probability of the likeliest class is from how often it is right."""
    top, right = p.max(1), p.argmax(1) == truth
    at = np.minimum((top * bins).astype(int), bins - 1)
    return float(sum(abs(top[at == b].mean() - right[at == b].mean()) * (at == b).mean() for b in range(bins) if (at == b).any()))


def held_out(patterns: list[str], other_names: list[str], seed: int = 31) -> dict[str, float]:
    """Figures on what no fit has seen: ``patterns`` with the families' names, and the licences ``other_names``.

    The whole model is judged on variations of those (unknown is right for the others) and of no licence.
    """
    model = train()
    order = list(TEMPLATES)
    given = [(order.index(f) + 2, p.format(name)) for f, own in NAMES.items() for name in own for p in patterns] + [(1, p.format(name)) for name in other_names for p in PATTERNS + patterns]
    texts, truth = variations(seed, given, 6)
    p, truth = _probabilities(scores(model, texts) / model.temperature), np.array(truth)
    best = p.argmax(1)
    told = np.where((best > 1) & (p.max(1) < model.least), 1, best)
    known, none, other = truth > 1, truth == 0, truth == 1
    return {
        "family_told_right": float((told == truth)[known].mean()),
        "family_told_wrong": float(((told > 1) & (told != truth))[known].mean()),
        "other_unknown": float((told == 1)[other].mean()),
        "other_told_as_family": float((told > 1)[other].mean()),
        "none_listed": float((told > 0)[none].mean()),
        "none_told_as_family": float((told > 1)[none].mean()),
        "calibration_error": reliability(p, truth),
        "least": model.least,
    }


def _trigrams(text: str) -> list[str]:
    words = _words(text)
    return list(dict.fromkeys(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))))


def _shingles(words: Column, n: int = 3) -> Column:
    """Column: hashes of the word trigrams; fewer words, the whole sequence."""
    several = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))
    return F.array_distinct(several)


def with_licences(docs: DataFrame, out: str = "licences", text_col: str = "text") -> DataFrame:
    """Add ``out``: array of struct(paragraph, family, probability, similarity, confirmed).

    ``paragraph`` counts the blocks between blank lines from 0.  Of a paragraph's windows and lines that
    are likelier a licence than none, each family that is told is listed with its most certain one; if
    none is told, ``unknown`` is.  ``similarity`` is the largest share of word trigrams that the window, or
    a template of the told family, has in the other (unknown: of any); ``confirmed``: a family is told, its
    similarity is at least 0.6, and no other family's is larger.  A null or empty text has none; each row is
    scanned alone, so repeated rows agree; other columns stay whatever their names; an empty table stays
    empty.  Work grows with the words of a text.
    """
    spark, model, own = docs.sparkSession, train(), own_names(docs, out)
    n = len(model.classes)
    flat = (model.weights / model.temperature).round(6)
    bias = (model.bias / model.temperature).round(6)
    gain = (flat[:, 1:].max(1) - flat[:, 0]).tolist()  # the most by which a gram can lift any licence over none
    start = float(bias[1:].max() - bias[0])
    hashed = [[[_signed_hash(s) for s in _trigrams(t)] for t in texts] for texts in TEMPLATES.values()]
    once = spark.createDataFrame([(flat.ravel().tolist(), gain, model.index.tolist(), hashed)], "w array<double>, g array<double>, x array<int>, t array<array<array<long>>>")
    df = docs.withColumns({own(c): once.select(c).scalar() for c in "wgxt"})  # one row, of the model's size
    w, g, x, templates = (F.col(own(c)) for c in "wgxt")
    names = F.array(*map(F.lit, model.classes))
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    row_of = lambda gram: F.get(x, F.pmod(F.xxhash64(gram), F.lit(HASHES)).cast("int"))

    no_rows, no_windows = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<struct<words:array<string>,grams:array<int>>>)")

    def read(words: Column) -> Column:
        """(words, one, two): the rows of weights of its unigrams and bigrams, -1 for those without."""
        n_words = F.size(words)
        pairs = F.when(n_words > 1, F.zip_with(F.slice(words, 1, n_words - 1), F.slice(words, 2, n_words - 1), lambda a, b: row_of(F.concat_ws(" ", a, b)))).otherwise(no_rows)
        return F.struct(words.alias("words"), F.transform(words, row_of).alias("one"), pairs.alias("two"))

    def together(lines: Column) -> Column:
        """The same of lines that have words, read as one: only the bigrams across their ends are new."""
        ends = lambda x, i: F.array(row_of(F.concat_ws(" ", F.element_at(F.get(lines, i - 1)["words"], -1), F.get(x["words"], F.lit(0)))))
        two = F.transform(lines, lambda x, i: F.when(i > 0, F.concat(ends(x, i), x["two"])).otherwise(x["two"]))
        joined = lambda field: F.flatten(F.transform(lines, lambda x: x[field]))
        return F.struct(joined("words").alias("words"), joined("one").alias("one"), F.flatten(two).alias("two"))

    def windows(of: Column) -> Column:
        """(words, grams) of a text's windows that may be a licence; none where all its gains together can't make one."""
        half = WINDOW // 2
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(of["words"]) - WINDOW) / half)).cast("int"))

        def cut(i: Column) -> Column:
            held = F.concat(F.slice(of["one"], i * half + 1, WINDOW), F.slice(of["two"], i * half + 1, WINDOW - 1))
            return F.struct(F.slice(of["words"], i * half + 1, WINDOW).alias("words"), F.array_distinct(F.filter(held, lambda k: k >= 0)).alias("grams"))

        likely = lambda s: F.aggregate(s["grams"], F.lit(start), lambda a, k: a + F.get(g, k)) > 0
        gained = lambda rows, so_far: F.aggregate(rows, so_far, lambda a, k: F.when(k < 0, a).otherwise(a + F.greatest(F.get(g, k), F.lit(0.0))))
        return F.when(gained(of["two"], gained(of["one"], F.lit(start))) > 0, F.filter(F.transform(starts, cut), likely)).otherwise(no_windows)

    def judged(s: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.aggregate(s["grams"], F.get(F.array(*map(F.lit, bias.tolist())), c), lambda a, k: a + F.get(w, k * n + c)))
        return bound(F.struct(each.alias("scores"), _shingles(s["words"]).alias("shingles")), told)

    def told(s: Column) -> Column:
        top = F.array_max(s["scores"])
        total = F.aggregate(s["scores"], F.lit(0.0), lambda a, v: a + F.exp(v - top))
        best = (F.array_position(s["scores"], top) - 1).cast("int")
        alike = F.transform(templates, lambda own_: F.array_max(F.transform(own_, lambda t: F.size(F.array_intersect(t, s["shingles"])) / F.least(F.size(t), F.size(s["shingles"])))))
        found = F.struct(best.alias("best"), (F.lit(1.0) / total).alias("probability"), F.when(best > 0, alike).alias("alike"))
        return bound(found, lambda f: named(f))

    def named(f: Column) -> Column:
        sure = (f["best"] > 1) & (f["probability"] >= model.least)
        most = F.array_max(f["alike"])
        like = F.when(sure, F.get(f["alike"], f["best"] - 2)).otherwise(most)
        return F.struct(
            F.round(f["probability"], 4).alias("probability"),
            F.round(F.coalesce(like, F.lit(0.0)), 4).alias("similarity"),
            F.when(f["best"] == 0, NONE).when(sure, F.get(names, f["best"])).otherwise(F.lit(UNKNOWN)).alias("family"),
            (sure & (like >= CONFIRMED) & (like >= most)).alias("confirmed"),
        )

    def listed(hits: Column, paragraph: Column) -> Column:
        families = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["family"])))
        best = lambda f: F.array_max(F.filter(hits, lambda h: h["family"] == f))
        rows = F.transform(families, lambda f: bound(best(f), lambda h: F.struct(paragraph.cast("int").alias("paragraph"), h["family"].alias("family"), h["probability"].alias("probability"), h["similarity"].alias("similarity"), h["confirmed"].alias("confirmed"))))
        return F.filter(rows, lambda r: (r["family"] != UNKNOWN) | (F.size(families) == 1))

    def scanned(paragraph: Column, i: Column) -> Column:
        words = F.transform(F.split(paragraph, "\n"), lambda line: F.regexp_extract_all(F.lower(line), F.lit(_WORD), F.lit(0)))
        lines = F.transform(F.filter(words, lambda x: F.size(x) > 0), read)

        def of(each: Column) -> Column:
            whole = F.when(F.size(each) > 1, bound(together(each), windows)).otherwise(no_windows)
            both = F.concat(whole, F.flatten(F.transform(each, windows)))
            return bound(F.filter(F.transform(both, judged), lambda h: h["family"] != NONE), lambda hits: listed(hits, i))

        return bound(lines, of)

    found = F.flatten(F.transform(F.split(text, _BLANK), scanned))
    return df.select(*kept_columns(docs, out), found.alias(out))


def licence_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_confirmed, families (confirmed, sorted, comma-joined), found: one row for each row.

    ``n_paragraphs`` counts the paragraphs that have something listed, ``n_confirmed`` what is confirmed;
    ``found`` lists paragraph:family:probability:similarity, comma-joined.  Rows are handled as
    ``with_licences`` says; a null id stays null.
    """
    got = with_licences(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")), "found")
    sure = F.filter("found", lambda x: x["confirmed"])
    listed = F.transform("found", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"], x["probability"].cast("string"), x["similarity"].cast("string")))
    return got.select(
        "doc_id",
        F.size(F.array_distinct(F.transform("found", lambda x: x["paragraph"]))).cast("long").alias("n_paragraphs"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(listed, ",").alias("found"),
    )
