import random
import re

from pyspark.sql import functions as F

from panelspark.llm import license_scan
from tests.llm.helpers import EDGES, docs, rows

GAPS = [" ", "  ", "\n", "\r\n\t", " **", "-", "_", ", \"", "\n * "]
PHRASES = ["All rights reserved", "Released under the MIT", "Published under GPL 3.0", "under the CC BY 4.0", "under Apache 2.0", "this is free and unencumbered software released into the public domain", "no topic under all of these free words"]


def test_gated_and_ungated_scans_agree(spark, monkeypatch):
    texts = [(100 + i, gap.join(p.split())) for i, (p, gap) in enumerate((p, gap) for p in PHRASES for gap in GAPS)]
    texts += [(1000 + i, t.upper()) for i, t in texts] + EDGES
    # One text for each rule that needs no choice of words.
    texts += [(3000 + i, "\n".join(f"{r.before} {r.anchor} {r.after}".split())) for i, r in enumerate(license_scan.RULES) if not re.search(r"[(\[]", r.before + r.after)]
    texts += [(6000 + i, f"under\n{b.replace('-', '\n').lower()}") for i, b in enumerate(license_scan.BARE)]
    gated = rows(license_scan.scan(docs(spark, texts)))
    monkeypatch.setattr(license_scan, "topical", lambda text: F.lit(True))
    monkeypatch.setattr(license_scan, "GATE", "")
    assert gated == rows(license_scan.scan(docs(spark, texts)))
    labels = {r[0]: r[6] for r in gated}
    assert all(labels[100 + i] == "proprietary" for i in range(len(GAPS))) and all(labels[100 + len(GAPS) + i] == "MIT" for i in range(len(GAPS)))


def plain_scan(text):
    """(start, end, label) of the detections that stay, every rule tried at every place on the whole text."""
    words = re.findall(license_scan.WORDS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found, in_tag, last = [], False, -99
    for i, w in enumerate(words):
        if tuple(words[max(0, i - 2) : i + 1]) == license_scan.TAG_WORDS:
            in_tag, last = True, i
        if w in license_scan.JOINTS:
            in_tag, last = in_tag and i - last <= 13, i
        left, right = " ".join(words[:i]), " ".join(words[i + 1 :])
        for no, r in enumerate(license_scan.RULES):
            if r.anchor != ("license" if w == "licence" else w) or r.in_tag and not in_tag:
                continue
            before = re.search(f"(?:^| )({r.before})$", left) if r.before else True
            after = re.match(f"({r.after})(?: |$)", right) if r.after else True
            if before and after:
                found.append((i - (len(before[1].split()) if r.before else 0), i + 1 + (len(after[1].split()) if r.after else 0), no, r.label))
                break
    inside = lambda x, y: y[0] <= x[0] and y[1] >= x[1]
    return sorted((x[0], x[1], x[3]) for x in found if not any(inside(x, y) and (y[2] < x[2] or (y[2] == x[2] and y[1] - y[0] > x[1] - x[0])) for y in found))


def test_detections_match_a_plain_loop(spark):
    rng = random.Random(4)
    plain = lambda p: re.sub(r"\(\?:([^()|]*)[^()]*\)\??(?:\{1,\d+\})?|\[(.)[^\]]*\]\??", r"\1\2", p)
    parts = [" ".join(f"{plain(r.before)} {r.anchor} {plain(r.after)}".split()) for r in license_scan.RULES]
    filler = "the of and or under all license licence free software only copyright mit apache general public gnu v2 or later 2 0".split()
    texts = [(i, " ".join(rng.choice([rng.choice(parts), " ".join(rng.choices(filler, k=4))]) for _ in range(12))) for i in range(60)]
    texts += [(100 + i, p) for i, p in enumerate(parts[::7])]
    got = {r["doc_id"]: sorted((d["start"], d["end"], d["label"]) for d in r["detections"]) for r in license_scan.scan(docs(spark, texts)).collect()}
    assert got == {i: plain_scan(t) for i, t in texts}


WHOLE = {
    "Licensed under the terms of the Do What The Fuck You Want To Public License": ("WTFPL", license_scan.GRANT),
    "SPDX-License-Identifier: Apache-2.0 OR MIT": ("Apache-2.0,MIT", license_scan.TAG),
    "SPDX-License-Identifier: (GPL-2.0-or-later OR MIT) AND BSD-3-Clause": ("BSD-3-Clause,GPL-2.0,MIT", license_scan.TAG),
    "License: MIT": ("MIT", license_scan.NAMED),
    "license = Apache-2.0": ("Apache-2.0", license_scan.NAMED),
    "Redistributions of source code must retain the above\ncopyright notice, this list of conditions": ("BSD-2-Clause", license_scan.SENTENCE),
    "either version 3 of the License, or": ("", 0.0),
    "under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or": ("GPL-3.0,gpl", license_scan.SENTENCE),
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": ("CC-BY-NC-SA-4.0", license_scan.NAME),
    "a mit, or an apache and others": ("", 0.0),
}


def test_known_texts(spark):
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs(spark, list(enumerate(WHOLE)))).collect()}
    assert got == dict(enumerate(WHOLE.values()))


def test_an_expression_of_40_names_is_read_whole_and_prose_after_it_is_not(spark):
    names = [n for n in license_scan.NAMES][:40]
    expression = f"SPDX-License-Identifier: {' OR '.join(names)}"
    far = " ".join(f"word{i}" for i in range(13))
    texts = [(1, expression), (2, f"// SPDX-License-Identifier: MIT OR {' OR '.join(['foo'] * 60)} OR Apache-2.0"), (3, f"SPDX-License-Identifier: MIT\n{far} or Apache-2.0 and so on"), (4, "salt or Apache-2.0"), (5, f"SPDX-License-Identifier: MIT OR ISC\n{far} and GPL-2.0\nSPDX-License-Identifier: BSD-2-Clause AND Zlib")]
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in license_scan.scan(docs(spark, texts)).collect()}
    assert got[1] >= set(names) and got[2] == {"MIT", "Apache-2.0"} and got[3] == {"MIT"} and got[4] == set() and got[5] == {"MIT", "ISC", "BSD-2-Clause", "Zlib"}


def test_short_names_after_under_and_before_licensed(spark):
    texts = {1: ("Released under the GPLv3", "GPL-3.0"), 2: ("available under BSD", "BSD"), 3: ("This software is BSD licensed", "BSD"), 4: ("under the WTFPL", "WTFPL"), 5: ("distributed under the zlib", "Zlib"), 6: ("It is MIT-licensed.", "MIT"), 7: ("under the bridge", ""), 8: ("under the terms of the AGPLv3", "AGPL-3.0")}
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs(spark, [(i, t) for i, (t, _) in texts.items()])).collect()}
    assert got == {i: want for i, (_, want) in texts.items()}
