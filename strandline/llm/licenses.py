"""Licence scan by a trained paragraph classifier (DataFrame functions only on the scan).

Comment marks at the start of lines are taken off first.  A paragraph is a block of lines between blank ones, read as one
(a notice may be wrapped), or a line of it where that stands for itself.  Its features are word 1- and 2-grams, present or
absent, other than those of stop words alone; a full stop is a word, and so is the end.  A sparse multinomial logistic
regression over them names the licence family or "none"; it is trained on the driver from ``licence_texts``, whole,
shortened and among other words, and from sentences that use the same words otherwise.  A temperature and a bound, fitted
on licences that no family covers, make the class "unknown"; so does a "none" that is not nearly certain.  A named family
is confirmed by comparison with its templates: the share of a template's word pairs that the paragraph has, in which pairs
of few families weigh more.  What is named but not confirmed is "unknown" as well.

Every feature counts only in a paragraph with an anchor word (``ANCHORS``; every licence text has one), so a paragraph
without an anchor has no feature and is "none": leaving such texts and paragraphs out changes nothing.
The scan needs no shuffle; paragraphs are scored by array functions inside their row.  The model is a literal of fixed size.

A block's lines are judged first.  The whole block stands for its lines if it is confirmed and every confirmed line is
less similar to its templates, or of a family without a version while the block is not; or if all lines are "none" and the
block is not.

Edge cases: null and empty texts are "none"; lines of any length are read whole; repeated rows get equal
results; ties go to the earlier line; a null doc_id stays; other columns are ignored; an empty
table stays empty.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = [
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
]
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
]
_REGENTS = [
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    _BSD[-1].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("COPYRIGHT HOLDER OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS").replace("COPYRIGHT OWNER OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"),
]
_REGENTS.append(_REGENTS[-1].split("DISCLAIMED.")[0] + "DISCLAIMED.")
_UNLICENSE = [
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
]
_CC0 = [
    "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission.",
]
_ISC = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
]
_APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, {v}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
#: GNU licences: name, what it is of, versions with the notice's wording of the version.
_GNU = {
    "gpl": ("General Public License", "program", {"2.0": "2", "3.0": "3"}),
    "lgpl": ("Lesser General Public License", "library", {"2.1": "2.1", "3.0": "3"}),
    "agpl": ("Affero General Public License", "program", {"3.0": "3"}),
}
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
#: How a licence is named in a sentence, and identifiers.
_NAMED = ["Licensed under the {0}.", "Released under the {0}.", "This software is distributed under the terms of the {0}.", "This work is licensed under the {0}.", "This library is licensed under the {0}.", "See the file LICENSE for the text of the {0}.", "under the {0}."]
#: Families that state no version.
GENERIC = ("gpl", "lgpl")


@lru_cache(maxsize=1)
def licence_texts() -> dict[str, list[str]]:
    """Texts that grant or name a licence, by family, paragraph by paragraph."""
    named = lambda *names: [s.format(n) for n in names for s in _NAMED]
    spdx = lambda *ids: [f"SPDX-License-Identifier: {i}" for i in ids]
    out = {
        "apache-2.0": [*_APACHE, *named("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"), *spdx("Apache-2.0")],
        "apache-1.1": [*named("Apache Software License, Version 1.1", "Apache License 1.1"), *spdx("Apache-1.1")],
        "mit": [_MIT_GRANT, *_MIT_REST, *named("MIT License", "MIT license (MIT)", "MIT license terms", "terms of the MIT license"), "Distributed under MIT license terms.", "under MIT license terms.", *spdx("MIT"), "The MIT License (MIT)"],
        "bsd": [*_BSD, *_REGENTS, *named("BSD License", "BSD 3-Clause License", "BSD 2-Clause License"), *spdx("BSD-3-Clause", "BSD-2-Clause"), "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
        "isc": [*_ISC, *named("ISC License"), *spdx("ISC")],
        "mpl-2.0": [_MPL.format(v="v. 2.0"), _MPL.format(v="version 2.0"), "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", *named("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"), *spdx("MPL-2.0")],
        "unlicense": ["This is free and unencumbered software released into the public domain.", *_UNLICENSE, *named("Unlicense"), *spdx("Unlicense")],
        "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", *_CC0, *named("CC0 1.0 Universal", "CC0 license", "CC0"), "Released under CC0.", "under CC0.", *spdx("CC0-1.0")],
        "all-rights-reserved": ["All rights reserved.", "Copyright by the authors. All rights reserved.", "Copyright 2019 the company. All rights reserved."],
    }
    for key, (name, thing, versions) in _GNU.items():
        for version, said in versions.items():
            full, short = f"GNU {name}", key.upper()
            head = f"This {thing} is free software{{}} you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation{{}} either version {said} of the License, or (at your option) any later version."
            only = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {full} version {said} as published by the Free Software Foundation."
            names = [f"{full}, version {said}", f"{full} version {said}", f"{full} v{version}", f"{short} v{said}", f"{short} version {said}", f"{short}v{said}"]
            ids = spdx(f"{short}-{version}", f"{short}-{version}-only", f"{short}-{version}-or-later", f"{short}-{version}+")
            out[f"{key}-{version}"] = [head.format(":", ","), head.format(";", ";"), only, *named(*dict.fromkeys(names)), *ids]
        if key in GENERIC:
            tail = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
            ends = ["If not, see <https://www.gnu.org/licenses/>.", "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."]
            out[key] = [tail, *(f"You should have received a copy of the GNU {name} along with this {thing}{c} {e}" for c, e in zip(".;", ends, strict=True)), *named(f"GNU {name}")]
    for key, name in _CC.items():
        for version in ("4.0", "3.0") if key in ("by", "by-sa", "by-nc") else ("4.0",):
            scope = "International" if version == "4.0" else "Unported"
            short = f"CC {key.upper()} {version}"
            lines = [f"This work is licensed under a Creative Commons {name} {version} {scope} License.", f"Creative Commons {name} {version} {scope} License", f"Creative Commons {name} License, version {version}", f"License: {short}"]
            out[f"cc-{key}-{version}"] = [*lines, *named(short, f"CC-{key.upper()}-{version}"), *spdx(f"CC-{key.upper()}-{version}")]
    return out


#: Sentences with the same words that grant nothing.
OTHER_USES = [
    "the driver had to renew a license before the trip", "her fishing licence was valid for one year", "a licensed electrician must check the wiring", "the apache helicopter landed near the camp",
    "a gnu is a large antelope that lives in herds", "he kept a reserved seat in the second row", "she was quiet and reserved at the meeting", "copyright law protects authors for many years",
    "the museum has licenses for its sound archive", "table reserved for the family", "the bsd of the unit was measured", "mozilla opened an office in the city", "the copyright office moved to a new building",
    "license plates are made by the state", "apache county lies in the north", "poetic license lets writers bend the rules", "reserved words cannot name a variable",
    "the teacher gave permission to leave early", "permission to land was granted by the tower", "without permission no one may enter the garden", "the wish was granted and the people were free",
    "the redistribution of land followed the war", "redistribution of wealth was the subject of the debate", "the warranty covers parts and labour for two years", "the phone is under warranty and the shop will repair it",
    "a version 2 of the engine was tested and version 3 followed", "the second version of the program is free for members", "any later version of the map shows the new road", "general public transport is free on sundays",
    "the software is provided by the school and the school pays for it", "the copyright holder of the song sued the band", "the author waived the fee for the students", "the public domain of the old king was sold",
    "neither the name of the town nor the names of its streets were known", "the liability of the owner ends at the fence", "the company limited its liability", "the foundation gave free software courses",
    "anyone is free to visit the garden and to copy the plan of it", "anyone is free to sell his house", "she was free to publish the book and to distribute it for any purpose", "the creative commons room is open to all", "the attribution of the painting is in doubt", "the mit campus lies by the river", "students of mit won the prize", "the license of the restaurant was revoked",
    "all rights and duties pass to the heir", "the rights of the tenant are reserved in the lease", "copies of the letter were sold at the market", "he may use and copy the notes without charge",
    "the merchantability of the grain was tested", "a disclaimer was printed on the ticket", "the terms of the contract were published", "under the terms of the treaty the border was open", "see the file for the text of the speech",
]
#: Licences that no family covers.
UNKNOWN = [
    "Licensed under the Eclipse Public License, version 1.0.", "Released under the Zlib License.", "Licensed under the Artistic License, Version 2.0.", "This work is licensed under the Open Data Commons License.",
    "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Academic Free License.", "Released under the Do What You Want License.", "Licensed under the European Union Public Licence.",
    "This software is distributed under the terms of the Python Software Foundation License.", "Licensed under the SIL Open Font License, Version 1.1.", "Released under the Common Development and Distribution License.", "SPDX-License-Identifier: EPL-2.0",
]
#: A paragraph without any of these (in any case) is "none".
ANCHORS = ["licens", "licenc", "copyright", "reserved", "permission", "redistribut", "warrant", "unencumbered", "anyone is free to", "gpl", "cc by", "cc-by", "cc\n", "cc0"]
ANCHOR_PATTERN = f"(?i){'|'.join(ANCHORS)}"
STOP = "a an and any are as at be by can for from he if in is it its may not of on one or she that the this to was were will with you all".split()
#: Comment marks at the start of a line, with the blanks around them.
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|dnl |REM )[ \t]*"
#: Ends a block of lines.
BLANK_LINES = r"\n(?:[ \t\x0B\f\r]*\n)+"
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*[+]?|[.]"
SIZES = (1, 2)
#: Least score of a paragraph that is left out as "none".
NONE_BOUND = 0.75
#: Least share of a template's pairs; digits to which scores are rounded before they are compared.
CONFIRM, DIGITS = 0.7, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> list[str]:
    """Words and full stops, with a stop at the end."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)) + " .")


def grams(tokens: list[str], sizes=SIZES) -> list[str]:
    return list(dict.fromkeys(" ".join(tokens[i : i + n]) for n in sizes for i in range(len(tokens) - n + 1)))


@dataclass
class LicenseModel:
    classes: list[str]  #: families, then "none"
    weights: dict[str, list[float]]  #: n-gram: one weight a class, divided by the temperature
    bias: list[float]
    bound: float
    templates: list[tuple[str, dict[str, float]]]  #: family, word pairs with their part of the similarity


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=2)
def train(seed: int = 4, variants: int = 8, keep: float = 0.05, rounds: int = 200) -> LicenseModel:
    """The model from the lists above.

    Matrix products differ in their last bits by machine and number of threads, so queries use the model that ``fitted`` reads;
    after a change of the lists ``python -m strandline.llm.licenses`` writes it anew.
    """
    rng = np.random.default_rng(seed)
    texts = licence_texts()
    filler = ["".join(rng.choice(["ba", "do", "ri", "sen", "tal", "um", "ver", "kol"], rng.integers(1, 4))) for _ in range(300)] + STOP + ["."]
    some = lambda k: list(rng.choice(filler, k))
    classes = [*texts, "none"]
    none = len(classes) - 1
    every = [(t, k) for k, family in enumerate(texts) for t in texts[family]]

    def vary(text: str, drop: float) -> list[str]:
        kept = [w for w in words(text) if rng.random() >= drop]
        return some(int(rng.integers(0, 12))) + kept + some(int(rng.integers(0, 12)))

    data = [(words(t), k) for t, k in every for _ in range(3)]
    data += [(vary(t, 0.08), k) for t, k in every for _ in range(variants)]
    data += [(vary(t, 0.1), none) for t in OTHER_USES for _ in range(2 * variants)]
    # other uses in a row, as in a block of prose, and single words of licences among others
    data += [(sum((vary(t, 0.1) for t in rng.choice(OTHER_USES, 6)), []), none) for _ in range(20 * variants)]
    lone = sorted({w for t, _ in every for w in words(t)} - set(STOP) - {"."})
    data += [([*some(3), str(rng.choice(lone)), *some(3)], none) for _ in range(60 * variants)]
    stop = set(STOP) | {"."}
    base = {g for t in [*(t for t, _ in every), *OTHER_USES] for g in grams(words(t)) if not stop.issuperset(g.split(" "))}
    vocabulary = sorted(base)
    place = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(vocabulary)), dtype=np.float64)
        for i, r in enumerate(rows):
            x[i, [place[g] for g in grams(r) if g in place]] = 1
        return x

    x, label = matrix([d[0] for d in data]), np.array([d[1] for d in data])
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)).mean()
    scale = float(x.max())
    want = np.eye(len(classes), dtype=np.float64)[label]
    w, b = np.zeros((len(vocabulary), len(classes)), dtype=np.float64), np.zeros(len(classes), dtype=np.float64)
    past = w
    for k in range(rounds):  # accelerated proximal gradient
        ahead = w + k / (k + 3) * (w - past)
        p = _softmax(x @ ahead + b) - want
        past = w
        w = ahead - 8 * (x.T @ p / len(x))
        w = np.sign(w) * np.maximum(np.abs(w) - 8e-5, 0)  # keeps few weights
        b = b - 4 * p.mean(axis=0)
    w, b = w.astype(np.float64) * scale, b.astype(np.float64)
    fresh = [(vary(t, 0.1), k) for t, k in every for _ in range(3)]
    strange = [vary(t, 0.0) for t in UNKNOWN for _ in range(10)]
    z, truth = matrix([d[0] for d in fresh]) @ w + b, np.array([d[1] for d in fresh])
    heat = min(np.geomspace(0.1, 10, 60), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean())
    known = np.sort(_softmax(z / heat).max(axis=1))
    odd = np.sort(_softmax((matrix(strange) @ w + b) / heat)[:, :-1].max(axis=1))
    # the bound with the fewest errors on both; the texts themselves, and with words after them, must stay above it
    bounds = np.linspace(0.2, 0.95, 76)
    wrong = [(known < t).mean() + (odd >= t).mean() for t in bounds]
    alone = [words(t + more) for more in ("", " and more of it after") for t, _ in every if not (more and t.endswith("All rights reserved."))]
    truth = [k for more in (False, True) for t, k in every if not (more and t.endswith("All rights reserved."))]
    own = _softmax((matrix(alone) @ w + b) / heat)[np.arange(len(alone)), truth].min()
    bound = min(float(bounds[int(np.argmin(wrong))]), 0.95 * float(own))
    weights = {g: np.round(w[i] / heat, DIGITS).tolist() for g, i in place.items() if np.abs(w[i] / heat).max() > keep}
    return LicenseModel(classes, weights, np.round(b / heat, DIGITS).tolist(), round(bound, 4), _templates(texts))


#: The fitted model.
FITTED = Path(__file__).with_name("license_model.json")


@lru_cache(maxsize=1)
def fitted() -> LicenseModel:
    """The model that ``train`` gave when the lists were last changed: the same numbers on every machine."""
    return LicenseModel(**json.loads(FITTED.read_text()))


def _templates(texts: dict[str, list[str]]) -> list[tuple[str, dict[str, float]]]:
    """The word pairs of every text; a pair counts the less, the more families have it.  Only where nothing but the end tells a grant from other uses are stops compared."""
    families: dict[str, set] = {}
    for family, own in texts.items():
        for g in {g for t in own for g in grams(words(t), (2,))}:
            families.setdefault(g, set()).add(family)
    out = []
    for family, own in texts.items():
        for t in own:
            found = [g for g in grams(words(t), (2,)) if family == "all-rights-reserved" or "." not in g.split(" ")]
            part = {g: 1 / len(families[g]) for g in found}
            out.append((family, {g: round(v / sum(part.values()), 9) for g, v in part.items()}))
    return out


def _constant(value, kind: str) -> Column:
    """A nested constant; as one literal it costs one call, and is folded before execution."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """(doc_id, license, score, similarity, n_paragraphs) of every row of docs (doc_id, text).

    license: the confirmed family with the highest score, those with a version first, else "unknown" if a paragraph looks
    like a licence, else "none"; score and similarity: of that paragraph; n_paragraphs: those that are not "none".
    """
    model = model or fitted()
    k = len(model.classes)
    vocabulary = _constant(list(model.weights), "array<string>")
    # n-grams and their weights by the first character, which makes the search for one short
    shelves: list[list[str]] = [[] for _ in range(128)]
    for g in model.weights:
        shelves[ord(g[0])].append(g)
    names, table = _constant(shelves, "array<array<string>>"), _constant([[model.weights[g] for g in shelf] for shelf in shelves], "array<array<array<double>>>")
    templates = _constant([[{"p": list(p), "w": list(p.values())} for f, p in model.templates if f == c] for c in model.classes], "array<array<struct<p:array<string>,w:array<double>>>>")
    every_pair = _constant(sorted({g for _, p in model.templates for g in p}), "array<string>")
    bias = _constant(model.bias, "array<double>")
    generic = [model.classes.index(g) + 1 for g in GENERIC]

    # each step binds what it made to a lambda's variable, so that nothing is evaluated for every word
    def tokens(s: Column) -> Column:
        t = F.regexp_extract_all(F.concat(F.translate(s["x"], UPPER, LOWER), F.lit(" .")), F.lit(WORD), F.lit(0))
        return F.struct(s["at"].alias("at"), s["whole"].alias("whole"), t.alias("t"))

    def paired(s: Column) -> Column:
        pairs = F.zip_with(s["t"], F.slice(s["t"], 2, F.greatest(F.size(s["t"]) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))  # the last is null
        return F.struct(s["at"].alias("at"), s["whole"].alias("whole"), F.concat(s["t"], pairs).alias("grams"))

    def met(s: Column) -> Column:
        """The n-grams of the model and the pairs of the templates."""
        return F.struct(s["at"].alias("at"), s["whole"].alias("whole"), F.array_intersect(vocabulary, s["grams"]).alias("grams"), F.array_intersect(every_pair, s["grams"]).alias("pairs"))

    def scored(s: Column) -> Column:
        weight = lambda g, shelf: F.get(F.get(table, shelf), F.array_position(F.get(names, shelf), g).cast("int") - 1)
        z = F.aggregate(s["grams"], bias, lambda acc, g: F.zip_with(acc, weight(g, F.ascii(g)), lambda a, b: a + b))
        return F.struct(s["at"].alias("at"), s["whole"].alias("whole"), z.alias("z"), s["pairs"].alias("pairs"))

    def topped(s: Column) -> Column:
        return F.struct(*(s[c].alias(c) for c in ("at", "whole", "z", "pairs")), F.array_max(s["z"]).alias("top"))

    def judged(s: Column) -> Column:
        total = F.aggregate(s["z"], F.lit(0.0), lambda acc, v: acc + F.exp(v - s["top"]))
        place = F.array_position(s["z"], s["top"])
        share = lambda t: F.aggregate(F.array_intersect(t["p"], s["pairs"]), F.lit(0.0), lambda acc, g: acc + F.get(t["w"], F.array_position(t["p"], g).cast("int") - 1))
        similarity = F.coalesce(F.array_max(F.transform(F.get(templates, place.cast("int") - 1), share)), F.lit(0.0))
        return F.struct(s["at"].alias("at"), s["whole"].alias("whole"), place.alias("place"), F.round(1 / total, DIGITS).alias("score"), F.round(similarity, DIGITS).alias("similarity"))

    first = "".join(sorted({c for w in ANCHORS for c in (w[0], w[0].upper())}))
    # the anchors' pattern with a fast way past all other characters
    fast = f"[{first}](?i)(?:{'|'.join(f'(?<={w[0]}){w[1:]}' for w in ANCHORS)})"
    anchored = F.coalesce(F.col("text").rlike(fast), F.lit(False))
    # lines and whole blocks with an anchor; of a block, the number of its first line, of a line its own, count from the text's start
    blocks = F.split(F.regexp_replace(F.when(anchored, F.col("text")), COMMENT, ""), BLANK_LINES)
    seen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blocks.alias("blocks"))
    split = lambda t: F.filter(F.transform(F.split(t, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.lit(False).alias("whole"))), lambda s: s["x"].rlike(ANCHOR_PATTERN))
    joined = lambda t: F.array(F.struct(F.translate(t, "\n", " ").alias("x"), F.lit(0).alias("i"), F.lit(True).alias("whole")))
    parts = lambda t: F.when(t.contains("\n"), F.concat(split(t), joined(t))).otherwise(split(t))
    some = F.filter(F.transform("blocks", lambda t, n: F.struct(t.alias("t"), n.alias("n"))), lambda s: s["t"].rlike(ANCHOR_PATTERN))
    seen = seen.select("doc_id", F.transform(some, lambda s: F.transform(parts(s["t"]), lambda x: F.struct(x["x"].alias("x"), F.struct(s["n"].alias("block"), x["i"].alias("line")).alias("at"), x["whole"].alias("whole")))).alias("blocks"))
    for step in (tokens, paired, met, scored, topped, judged):
        seen = seen.select("doc_id", F.transform("blocks", lambda t: F.transform(t, step)).alias("blocks"))  # noqa: B023
    firm = lambda s: (s["score"] >= model.bound) & (s["similarity"] >= CONFIRM)
    exact = lambda s: firm(s) & ~s["place"].isin(generic)
    licence = lambda s: (s["place"] != k) | (s["score"] < NONE_BOUND)

    def chosen(block: Column) -> Column:
        found = F.filter(block, licence)
        own, whole = F.filter(found, lambda s: ~s["whole"]), F.filter(found, lambda s: s["whole"])
        closest = F.coalesce(F.array_max(F.transform(F.filter(own, firm), lambda s: s["similarity"])), F.lit(-1.0))
        better = F.exists(whole, lambda s: firm(s) & (s["similarity"] > closest)) | (F.exists(whole, exact) & ~F.exists(own, exact))
        return F.when((F.size(own) == 0) | better, whole).otherwise(own)

    licences = F.flatten(F.transform("blocks", chosen))
    seen = seen.select("doc_id", licences.alias("licences"))
    licences = F.col("licences")
    order = F.transform(licences, lambda s: F.struct(firm(s).cast("int").alias("firm"), exact(s).cast("int").alias("exact"), s["score"].alias("score"), (-s["at"]["block"]).alias("block"), (-s["at"]["line"]).alias("line"), s["place"].alias("place"), s["similarity"].alias("similarity")))
    seen = seen.select("doc_id", F.array_max(order).alias("best"), F.coalesce(F.size(licences), F.lit(0)).alias("n"))
    name = F.when(F.col("best").isNull(), "none").when(F.col("best.firm") == 1, F.element_at(_constant(model.classes, "array<string>"), F.col("best.place").cast("int"))).otherwise("unknown")
    return seen.select("doc_id", name.alias("license"), F.col("best.score").alias("score"), F.col("best.similarity").alias("similarity"), F.greatest("n", F.lit(0)).cast("bigint").alias("n_paragraphs"))


def scan_sql(model: LicenseModel | None = None, table: str = "documents") -> str:
    """The same as DuckDB SQL, by joins over exploded n-grams."""
    model = model or fitted()
    k = len(model.classes)
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({text(g)}, [{', '.join(map(repr, w))}])" for g, w in model.weights.items())
    pairs = ", ".join(f"({n}, {model.classes.index(f) + 1}, {text(g)}, {v!r})" for n, (f, p) in enumerate(model.templates) for g, v in p.items())
    names = ", ".join(f"'{c}'" for c in model.classes)
    generic = ", ".join(str(model.classes.index(g) + 1) for g in GENERIC)
    logits = ", ".join(f"{b!r} + coalesce(sum(w[{i + 1}]), 0)" for i, b in enumerate(model.bias))
    blank = BLANK_LINES.replace(r"\f", r"\x0C")
    return rf"""
WITH weights(g, w) AS (VALUES {rows}), template(n, place, g, part) AS (VALUES {pairs}),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM {table}),
bs AS (SELECT rid, string_split_regex(regexp_replace(text, '{COMMENT}', '', 'g'), '{blank}') AS b FROM d WHERE regexp_matches(text, '{ANCHOR_PATTERN}')),
bl AS (SELECT rid, unnest(b) AS x, generate_subscripts(b, 1) - 1 AS bn FROM bs),
l AS (SELECT rid, bn, unnest(string_split(x, chr(10))) AS x, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS ln, false AS whole FROM bl
      UNION ALL SELECT rid, bn, replace(x, chr(10), ' '), 0, true FROM bl WHERE contains(x, chr(10))),
t AS (SELECT rid, bn, ln, whole, regexp_extract_all(translate(x, '{UPPER}', '{LOWER}') || ' .', '{WORD}') AS t FROM l WHERE regexp_matches(x, '{ANCHOR_PATTERN}')),
g AS (SELECT DISTINCT rid, bn, ln, whole, n, array_to_string(t[i:i + n - 1], ' ') AS g
      FROM (SELECT rid, bn, ln, whole, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, (VALUES (1), (2)) s(n))),
z AS (SELECT rid, bn, ln, whole, [{logits}] AS z FROM t LEFT JOIN g USING (rid, bn, ln, whole) LEFT JOIN weights USING (g) GROUP BY ALL),
p AS (SELECT rid, bn, ln, whole, list_position(z, list_max(z)) AS place,
             round(1 / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))), {DIGITS}) AS score FROM z),
s AS (SELECT rid, bn, ln, whole, template.n, place, sum(CAST(part AS DOUBLE)) AS similarity FROM g JOIN template USING (g) WHERE g.n = 2 GROUP BY ALL),
j AS (SELECT p.rid, p.bn, p.ln, p.whole, p.place, score, round(coalesce(max(similarity), 0), {DIGITS}) AS similarity
      FROM p LEFT JOIN s ON s.rid = p.rid AND s.bn = p.bn AND s.ln = p.ln AND s.whole = p.whole AND s.place = p.place WHERE p.place <> {k} OR score < {NONE_BOUND} GROUP BY ALL),
f AS (SELECT *, score >= {model.bound} AND similarity >= {CONFIRM} AS firm, firm AND place NOT IN ({generic}) AS exact FROM j),
w AS (SELECT *, count(CASE WHEN NOT whole THEN 1 END) OVER b AS own, coalesce(max(CASE WHEN whole AND firm THEN similarity END) OVER b, -2) > coalesce(max(CASE WHEN NOT whole AND firm THEN similarity END) OVER b, -1) AS closer,
             coalesce(bool_or(whole AND exact) OVER b, false) AS we, coalesce(bool_or(NOT whole AND exact) OVER b, false) AS le FROM f WINDOW b AS (PARTITION BY rid, bn)),
b AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY firm DESC, exact DESC, score DESC, bn, ln) AS r, count(*) OVER (PARTITION BY rid) AS n
      FROM w WHERE whole = (own = 0 OR closer OR (we AND NOT le)))
SELECT doc_id, CASE WHEN b.rid IS NULL THEN 'none' WHEN firm THEN [{names}][place] ELSE 'unknown' END AS license,
       score, similarity, CAST(coalesce(n, 0) AS BIGINT) AS n_paragraphs
FROM d LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON b.rid = d.rid
"""


if __name__ == "__main__":
    FITTED.write_text(json.dumps(asdict(train()), indent=0) + "\n")
