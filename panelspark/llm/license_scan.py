"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame functions only.

A text is read as its sequence of words. A rule is a regex with an anchor, a
keyword that every match contains; only at places of its anchor is a rule
tried, on the words before and after. Of the rules that match at one place the
first in order wins; then a detection that lies within another one of higher
priority is suppressed. Places are at most ``WINDOW`` words wide on each side,
as wide as the widest rule, so neighbours in the row settle every containment: no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.arrays import captured, with_running
from panelspark.llm.common import lower_ascii, text_of

# Words and the base phrases with their labels.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License identifiers and the phrases that name them, as words.
# "{l}" is the word license in either spelling.
NAMES = {
    "Apache-1.0": ["apache software {l} 1 0", "apache {l} 1 0", "apache {l} version 1 0"],
    "Apache-1.1": ["apache software {l} 1 1", "apache {l} 1 1", "apache {l} version 1 1", "apache software {l} version 1 1"],
    "Apache-2.0": ["apache {l} version 2 0", "apache {l} 2 0", "apache {l} v2 0", "apache software {l} version 2 0", "apache 2 0 {l}"],
    "MIT": ["mit {l}", "expat {l}", "mit expat {l}", "x11 mit {l}"],
    "MIT-0": ["mit no attribution {l}"],
    "X11": ["x11 {l}"],
    "ISC": ["isc {l}", "internet systems consortium {l}"],
    "BSD-2-Clause": ["bsd 2 clause {l}", "2 clause bsd {l}", "simplified bsd {l}", "freebsd {l}", "two clause bsd {l}"],
    "BSD-3-Clause": ["bsd 3 clause {l}", "3 clause bsd {l}", "new bsd {l}", "modified bsd {l}", "revised bsd {l}", "three clause bsd {l}"],
    "BSD-4-Clause": ["bsd 4 clause {l}", "4 clause bsd {l}", "original bsd {l}", "four clause bsd {l}"],
    "0BSD": ["zero clause bsd {l}", "0 clause bsd {l}"],
    "GPL-1.0": ["gnu general public {l} version 1", "general public {l} version 1", "general public {l} v1"],
    "GPL-2.0": ["gnu general public {l} version 2", "general public {l} version 2", "general public {l} v2", "gpl 2 0 {l}"],
    "GPL-3.0": ["gnu general public {l} version 3", "general public {l} version 3", "general public {l} v3", "gpl 3 0 {l}"],
    "GPL": ["gnu general public {l}", "general public {l}", "gpl {l}"],
    "LGPL-2.0": ["gnu library general public {l} version 2", "library general public {l} version 2"],
    "LGPL-2.1": ["gnu lesser general public {l} version 2 1", "lesser general public {l} version 2 1"],
    "LGPL-3.0": ["gnu lesser general public {l} version 3", "lesser general public {l} version 3"],
    "LGPL": ["gnu lesser general public {l}", "lesser general public {l}", "library general public {l}", "lgpl {l}"],
    "AGPL-3.0": ["gnu affero general public {l} version 3", "affero general public {l} version 3"],
    "AGPL": ["gnu affero general public {l}", "affero general public {l}", "agpl {l}"],
    "GFDL-1.3": ["gnu free documentation {l} version 1 3"],
    "GFDL": ["gnu free documentation {l}", "free documentation {l}"],
    "MPL-1.1": ["mozilla public {l} version 1 1", "mozilla public {l} 1 1"],
    "MPL-2.0": ["mozilla public {l} version 2 0", "mozilla public {l} 2 0", "mozilla public {l} v 2 0"],
    "EPL-1.0": ["eclipse public {l} 1 0", "eclipse public {l} version 1 0", "eclipse public {l} v1 0"],
    "EPL-2.0": ["eclipse public {l} 2 0", "eclipse public {l} version 2 0", "eclipse public {l} v2 0"],
    "EUPL-1.2": ["european union public {l} 1 2", "european union public {l} version 1 2", "european union public {l}"],
    "CDDL-1.0": ["common development and distribution {l} 1 0", "common development and distribution {l} version 1 0", "common development and distribution {l}"],
    "CPL-1.0": ["common public {l} 1 0", "common public {l} version 1 0", "common public {l}"],
    "BSL-1.0": ["boost software {l} 1 0", "boost software {l} version 1 0", "boost software {l}"],
    "Zlib": ["zlib {l}", "zlib libpng {l}"],
    "Libpng": ["libpng {l}", "png reference library {l}"],
    "PSF-2.0": ["python software foundation {l} version 2", "python software foundation {l}", "psf {l}"],
    "Artistic-1.0": ["artistic {l} 1 0"],
    "Artistic-2.0": ["artistic {l} 2 0", "artistic {l} version 2 0"],
    "Ruby": ["ruby {l}"],
    "PHP-3.01": ["php {l} version 3 01", "php {l} 3 01"],
    "OFL-1.1": ["sil open font {l} version 1 1", "open font {l} version 1 1", "open font {l}"],
    "OSL-3.0": ["open software {l} version 3 0", "open software {l} 3 0"],
    "AFL-3.0": ["academic free {l} version 3 0", "academic free {l} 3 0"],
    "MS-PL": ["microsoft public {l}"],
    "MS-RL": ["microsoft reciprocal {l}"],
    "WTFPL": ["do what the fuck you want to public {l}"],
    "Unlicense": ["unlicense {l}"],
    "ODbL-1.0": ["open database {l} 1 0", "open data commons open database {l}", "open database {l}"],
    "ODC-By-1.0": ["open data commons attribution {l}"],
    "CC0-1.0": ["cc0 1 0 {l}", "cc0 {l}", "creative commons zero {l}"],
    "CC-BY-3.0": ["creative commons attribution 3 0 {l}", "cc by 3 0 {l}"],
    "CC-BY-4.0": ["creative commons attribution 4 0 {l}", "creative commons attribution 4 0 international {l}", "cc by 4 0 {l}"],
    "CC-BY": ["creative commons attribution {l}", "cc by {l}"],
    "CC-BY-SA-3.0": ["creative commons attribution sharealike 3 0 {l}", "cc by sa 3 0 {l}"],
    "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0 {l}", "creative commons attribution sharealike 4 0 international {l}", "cc by sa 4 0 {l}"],
    "CC-BY-SA": ["creative commons attribution sharealike {l}", "cc by sa {l}"],
    "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4 0 {l}", "creative commons attribution noncommercial 4 0 international {l}", "cc by nc 4 0 {l}"],
    "CC-BY-NC": ["creative commons attribution noncommercial {l}", "cc by nc {l}"],
    "CC-BY-ND-4.0": ["creative commons attribution noderivatives 4 0 {l}", "cc by nd 4 0 {l}"],
    "CC-BY-NC-SA-4.0": ["creative commons attribution noncommercial sharealike 4 0 {l}", "creative commons attribution noncommercial sharealike 4 0 international {l}", "cc by nc sa 4 0 {l}"],
    "CC-BY-NC-ND-4.0": ["creative commons attribution noncommercial noderivatives 4 0 {l}", "cc by nc nd 4 0 {l}"],
}
#: Named without the word license after "under".
BARE = ["Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL", "LGPL", "AGPL", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-SA", "CC-BY-NC-4.0", "CC-BY-NC", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"]
BARE_VERSIONED = {"CC-BY-NC": "3 0", "CC-BY-SA": "2 0", "CC-BY": "2 0"}
#: Sentences of license texts, as words: what stands before the anchor, the anchor, what follows.
SENTENCES = [
    ("MIT", "", "permission", "is hereby granted free of charge to any person obtaining a copy"),
    ("MIT", "the above copyright notice and this", "permission", "notice shall be included in all copies or substantial portions of the software"),
    ("MIT", "to deal in the software without", "restriction", "including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("MIT", "shall the authors or", "copyright", "holders be liable for any claim damages or other liability"),
    ("X11", "except as contained in this notice the name of the x consortium shall not be used in", "advertising", "or otherwise to promote the sale"),
    ("ISC", "", "permission", "to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "provided that the above copyright notice and this", "permission", "notice appear in all copies"),
    ("BSD-3-Clause", "", "redistribution", "and use in source and binary forms with or without modification are permitted"),
    ("BSD-2-Clause", "", "redistributions", "of source code must retain the above copyright notice this list of conditions"),
    ("BSD-2-Clause", "", "redistributions", "in binary form must reproduce the above copyright notice this list of conditions"),
    ("BSD-3-Clause", "neither the name of (?:[a-z0-9]+ ){1,6}nor the names of its", "contributors", "may be used to endorse or promote products"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written", "permission", ""),
    ("BSD-4-Clause", "all", "advertising", "materials mentioning features or use of this software must display the following acknowledg[e]?ment"),
    ("Apache-2.0", "", "under", "the apache license version 2 0 the license you may not use this file except in compliance"),
    ("Apache-2.0", "you may obtain a copy of the", "license", "at (?:https? )?(?:www )?apache org licenses license 2 0"),
    ("Apache-2.0", "software distributed", "under", "the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("Apache-2.0", "see the", "license", "for the specific language governing permissions and limitations"),
    ("Apache-2.0", "licensed to the apache software foundation asf", "under", "one or more contributor license agreements"),
    ("Apache-1.1", "this product includes software developed by the apache software foundation", "acknowledgment", ""),
    ("GPL", "this program is", "free", "software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("GPL", "this file is", "free", "software you can redistribute it and or modify"),
    ("GPL", "this program is", "free", "software you can redistribute it and or modify"),
    ("GPL-2.0", "", "under", "the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("GPL-3.0", "", "under", "the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("GPL-2.0", "", "under", "the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("GPL", "you should have received a copy of the gnu general public", "license", "along with this program"),
    ("LGPL", "this library is", "free", "software you can redistribute it and or modify"),
    ("LGPL-2.1", "", "under", "the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("LGPL-3.0", "", "under", "the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("LGPL", "you should have received a copy of the gnu lesser general public", "license", "along with this library"),
    ("AGPL-3.0", "", "under", "the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("GFDL", "", "permission", "is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public", "license", "v 2 0"),
    ("MPL-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "https", "mozilla org mpl 2 0"),
    ("MPL-1.1", "the contents of this file are subject to the mozilla public", "license", "version 1 1"),
    ("EPL-1.0", "this program and the accompanying materials are made available", "under", "the terms of the eclipse public license v1 0"),
    ("EPL-2.0", "this program and the accompanying materials are made available", "under", "the terms of the eclipse public license (?:v )?2 0"),
    ("CDDL-1.0", "the contents of this file are subject to the terms of the common development and distribution", "license", ""),
    ("BSL-1.0", "distributed", "under", "the boost software license version 1 0"),
    ("BSL-1.0", "", "permission", "is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Zlib", "", "permission", "is granted to anyone to use this software for any purpose including commercial applications"),
    ("Zlib", "altered source versions must be plainly marked as such and must not be", "misrepresented", "as being the original software"),
    ("Zlib", "the origin of this software must not be", "misrepresented", "you must not claim that you wrote the original software"),
    ("PSF-2.0", "psf hereby grants", "licensee", "a nonexclusive royalty free world wide license"),
    ("Artistic-2.0", "the intent is that the", "copyright", "holder maintains some artistic control over the development"),
    ("PHP-3.01", "this source file is subject to version 3 01 of the php", "license", ""),
    ("OFL-1.1", "this font software is", "licensed", "under the sil open font license version 1 1"),
    ("OFL-1.1", "reserved font name", "means", "a name reserved"),
    ("MS-PL", "this license governs use of the accompanying software if you use the software you accept this", "license", ""),
    ("WTFPL", "everyone is", "permitted", "to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("Unlicense", "this is free and", "unencumbered", "software released into the public domain"),
    ("Unlicense", "anyone is free to copy modify publish use compile sell or distribute this", "software", "either in source code form"),
    ("CC0-1.0", "to the extent possible", "under", "law (?:[a-z0-9]+ ){1,8}has waived all copyright and related or neighboring rights"),
    ("CC0-1.0", "the person who associated a work with this deed has", "dedicated", "the work to the public domain"),
    ("CC-BY", "you are free to share copy and redistribute the material in any medium or", "format", ""),
    ("CC-BY-SA", "if you remix transform or build upon the material you must distribute your contributions", "under", "the same license as the original"),
    ("CC-BY-NC", "you may not use the material for", "commercial", "purposes"),
    ("CC-BY-ND", "if you remix transform or build upon the material you may not", "distribute", "the modified material"),
    ("public-domain", "", "dedicated", "to the public domain"),
    ("public-domain", "this work is in the public", "domain", ""),
    ("public-domain", "placed in(?:to)? the public", "domain", ""),
    ("proprietary", "", "unauthorized", "copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary and", "confidential", ""),
    ("proprietary", "", "all", "rights reserved"),
    ("proprietary", "no part of this (?:publication|work|document|book) may be", "reproduced", ""),
    ("proprietary", "for internal use", "only", "do not distribute"),
    ("warranty-disclaimer", "without even the implied", "warranty", "of merchantability or fitness for a particular purpose"),
    ("warranty-disclaimer", "the software is provided as is without", "warranty", "of any kind"),
    ("warranty-disclaimer", "any express or implied", "warranties", "including but not limited to the implied warranties of merchantability"),
    ("copyright", "", "copyright", "c (?:19|20)[0-9][0-9]"),
    ("copyright", "", "copyright", "(?:19|20)[0-9][0-9]"),
    ("copyright", "", "copyright", "© (?:19|20)[0-9][0-9]"),
    ("copyright", "", "copyrighted", "by"),
]
#: Labels that tell of rights in general rather than of a license.
NOTICES = ("proprietary", "copyright", "warranty-disclaimer", "public-domain")
#: Named after "license", as in "License: MIT", or by their short names in an expression.
SHORT = {
    "Apache-2.0": "apache 2(?: 0)?", "MIT": "mit", "ISC": "isc", "BSD-2-Clause": "bsd 2 clause", "BSD-3-Clause": "bsd 3 clause", "GPL-2.0": "gpl(?: v2|v2| 2(?: 0)?)", "GPL-3.0": "gpl(?: v3|v3| 3(?: 0)?)", "LGPL-2.1": "lgpl(?: v|v| )?2 1", "LGPL-3.0": "lgpl(?: v|v| )?3(?: 0)?",
    "AGPL-3.0": "agpl(?: v|v| )?3(?: 0)?", "MPL-2.0": "mpl(?: v|v| )?2 0", "EPL-2.0": "epl(?: v|v| )?2 0", "BSL-1.0": "bsl 1 0", "Zlib": "zlib", "WTFPL": "wtfpl", "Unlicense": "unlicense", "0BSD": "0bsd", "CC0-1.0": "cc0(?: 1 0)?", "CC-BY-SA-4.0": "cc by sa 4 0", "CC-BY-NC-4.0": "cc by nc 4 0", "CC-BY-4.0": "cc by 4 0", "OFL-1.1": "ofl 1 1", "Artistic-2.0": "artistic 2 0",
    "GPL": "gpl", "LGPL": "lgpl", "AGPL": "agpl",
}

TAG, SENTENCE, GRANT, URL, NAMED, NAME, NOTICE = 1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.4


@dataclass(frozen=True)
class Rule:
    """before + anchor + after, words joined by one space; the list's order is the priority.

    A rule in a tag holds only at a joint of a tag's expression; see :data:`JOINTS`.
    """

    label: str
    anchor: str
    before: str
    after: str
    confidence: float
    in_tag: bool = False


#: Between the names of a tag's expression: "Apache-2.0 OR MIT". An expression has any number of names, of so many words each:
#: a joint belongs to it if the tag or the joint before it, which belongs to it, is not further away.
JOINTS, OPERAND = ("or", "and"), 12
TAG_WORDS = ("spdx", "license", "identifier")


def _alias(phrase: str) -> tuple[str, str]:
    before, _, after = phrase.partition("{l}")
    return before.strip(), after.strip()


def rules() -> list[Rule]:
    """All rules, in order: identifiers, sentences, grants, links, then names; the longer name first."""
    out: list[Rule] = []
    for label in sorted(NAMES, key=lambda n: -len(n)):  # so that MIT-0 isn't taken for MIT
        words = " ".join(w for w in label.lower().replace(".", " ").replace("-", " ").split())
        out.append(Rule(label, "identifier", "spdx license", words + "(?: or later| only)?", TAG))
        for joint in JOINTS:
            out.append(Rule(label, joint, "", words + "(?: or later| only)?", TAG, in_tag=True))
    for label, before, anchor, after in SENTENCES:
        out.append(Rule(label, anchor, before, after, NOTICE if label in NOTICES else SENTENCE))
    phrases = sorted(((p, label) for label, ps in NAMES.items() for p in ps), key=lambda x: -len(x[0]))
    grants, names = [], []
    for phrase, label in phrases:
        plain = phrase.replace("{l}", "licen[sc]e")
        grants.append(Rule(label, "under", "", f"(?:the terms of )?(?:the |a |an )?(?:gnu )?{plain}", GRANT))
        before, after = _alias(phrase)
        names.append(Rule(label, "license", before, after, NAME))
    bare = sorted(((b.lower().replace(".", " ").replace("-", " "), b) for b in BARE), key=lambda x: -len(x[0]))
    grants += [Rule(f"{label}", "under", "", f"(?:the )?{' '.join(w.split())}(?: {BARE_VERSIONED[label]})?" if label in BARE_VERSIONED else f"(?:the )?{w}", GRANT) for w, label in bare]
    urls = []
    for label in NAMES:
        slug = label.lower().replace(".", " ").replace("-", " ")
        urls.append(Rule(label, "licenses", "(?:opensource|spdx|gnu|apache) org", slug, URL))
        if label.startswith("CC-"):
            kind = label.lower().replace("cc-", "", 1).replace(".", " ").replace("-", " ")
            urls.append(Rule(label, "licenses", "creativecommons org", kind, URL))
    named = [Rule(label, "license", "", f"(?:is |type |name |the )?{short}", NAMED) for label, short in SHORT.items()]
    plain = SHORT | {"BSD": "bsd"}
    grants += [Rule(label, "under", "", f"(?:the terms of )?(?:the |a |an )?{short}", GRANT) for label, short in plain.items()]
    named += [Rule(label, "licensed", short, "", NAMED) for label, short in plain.items()]
    return out + grants + named + sorted(urls, key=lambda r: -len(r.after)) + names


RULES = rules()
#: Words that a rule may look at on one side of its anchor, at most: no rule is cut. A gap of n words counts n times.
WINDOW = max(len(p.replace("{1,8}", " " * 7).replace("{1,6}", " " * 5).split(" ")) for r in RULES for p in (r.before, r.after))
ANCHORS = sorted({r.anchor for r in RULES})
#: The prefilter: no rule and no base phrase matches a text without one of these words.
GATE = r"(?i)(?<![a-z0-9])(?:" + "|".join([*ANCHORS, "licence"]) + r")(?![a-z0-9])"
#: Many anchors are common words; a text needs one of these besides: a word's beginning, or a phrase.
TOPICS = ("licens", "licenc", "copyright", "spdx", "redistribut", "permission", "unencumbered")
#: Looked for only in texts that hold the word named first.
#: Words of a phrase may have anything between them that is no word: line breaks, several spaces, punctuation.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [
    ("reserved", "rights reserved"), ("reserved", "reserved font name"), ("under", "under (?:the terms of )?(?:the |an? )?(?:mit|isc|0?bsd|bsl|apache|a?l?gpl|mpl|epl|cc|zlib|wtfpl|unlicense|ofl|artistic)"), ("domain", "public domain"), ("artistic", "artistic control"), ("mozilla", "mozilla org"), ("advertising", "advertising (?:materials|or otherwise)"),
    ("misrepresented", "be misrepresented"), ("foundation", "apache software foundation"), ("internal", "internal use only"), ("confidential", "and confidential"), ("reproduced", "may be reproduced"), ("unauthorized", "unauthorized copying"), ("warrant", "implied warrant"), ("warrant", "without warranty"),
    ("format", "medium or format"), ("distribute", "not distribute"), ("commercial", "for commercial purposes"), ("endorse", "endorse or promote"), ("restriction", "without restriction"), ("compile", "use compile"),
]


def topical(low: Column) -> Column:
    """Whether a lower-case text may be about rights at all; never stricter than the rules. Most texts end here."""
    tests = [low.contains(t) for t in TOPICS]
    tests += [low.contains(word) & low.rlike(phrase.replace(" ", _GAP)) for word, phrase in PHRASES]
    return reduce(lambda a, b: a | b, tests)


HIT = "struct<start:int,end:int,rule:int,label:string,confidence:double>"


def _detect(x: str = "x") -> str:
    """SQL for the first rule that matches at a place x, or null. Rules hold no quotes or backslashes."""
    words = lambda s: f"if(length(trim({s})) = 0, 0, size(split(trim({s}), ' ')))"
    by_anchor: dict[str, list[str]] = {}
    for no, r in enumerate(RULES):
        before, after = f"(?:^| )({r.before})$", f"^({r.after})(?: |$)"
        fits = [f"{x}.left RLIKE '{before}'"] * bool(r.before) + [f"{x}.right RLIKE '{after}'"] * bool(r.after)
        start = f"{x}.at - {words(f"regexp_extract({x}.left, '{before}', 1)")}" if r.before else f"{x}.at"
        end = f"{x}.at + 1 + {words(f"regexp_extract({x}.right, '{after}', 1)")}" if r.after else f"{x}.at + 1"
        by_anchor.setdefault(r.anchor, []).append(f"WHEN {' AND '.join(fits) or 'true'} THEN named_struct('start', {start}, 'end', {end}, 'rule', {no}, 'label', '{r.label}', 'confidence', {r.confidence}D)")
    return "CASE " + " ".join(f"WHEN {x}.anchor = '{name}' THEN CASE {' '.join(own)} END" for name, own in by_anchor.items()) + " END"


def _with_joints(df: DataFrame) -> DataFrame:
    """df, which has the words ``_w``, plus ``_joints``: places of the joints that belong to a tag's expression; null without a tag.

    Tags and joints in order: a tag sets an odd mark, a joint too far from what
    stands before it an even one, other joints none. The last mark up to a
    joint says whether it belongs to a tag: a running maximum.
    """
    w = F.col("_w")
    is_tag = lambda i: (F.get(w, i) == TAG_WORDS[2]) & (F.get(w, i - 1) == TAG_WORDS[1]) & (F.get(w, i - 2) == TAG_WORDS[0])
    spots = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(*JOINTS) | is_tag(i))
    df = df.withColumn("_spots", F.when(F.array_contains(w, TAG_WORDS[0]), captured(w, spots)))
    spots = F.col("_spots")
    mark = lambda i, k: F.when(F.get(w, i) == TAG_WORDS[2], 2 * k + 1).when(i - F.get(spots, k - 1) <= OPERAND + 1, 0).otherwise(2 * k).cast("long")
    df = with_running(df.withColumn("_marks", captured(spots, F.transform(spots, mark))), {"_marks": "_before"}, F.greatest)
    belongs = F.filter(F.arrays_zip("_spots", "_marks", "_before"), lambda x: F.get(w, x["_spots"]).isin(*JOINTS) & (F.greatest(x["_marks"], x["_before"]) % 2 == 1))
    return df.withColumn("_joints", F.transform(belongs, lambda x: x["_spots"])).drop("_spots", "_marks", "_before")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    One row for each row of docs, repeated ones too; only doc_id and text are
    read. A null text counts as empty: no words, no places, null first_word and
    last_word, empty labels, score 0; an empty table gives none. ``detections`` has (start, end, label,
    confidence) in words, end exclusive; base phrases are never suppressed.
    score is the highest confidence found.
    """
    df = docs.select("doc_id", text_of().alias("_t")).withColumn("_low", F.lower("_t"))
    gated = topical(F.col("_low")) & F.col("_t").rlike(GATE)
    tokens = F.when(gated, F.regexp_extract_all(lower_ascii(F.col("_t")), F.lit(WORDS), F.lit(0)))
    df = df.select("doc_id", F.regexp_count("_t", F.lit(WORDS)).cast("long").alias("n_words"), tokens.alias("_w"))
    w = F.col("_w")
    df = _with_joints(df)
    others = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin([*(a for a in ANCHORS if a not in JOINTS), "licence"]))
    places = F.array_sort(F.concat(others, F.coalesce("_joints", F.array().cast("array<int>"))))
    df = df.withColumn("_at", F.when(F.size(w) > 0, places))
    around = lambda i: F.struct(
        i.alias("at"),
        F.get(w, i).alias("word"),
        F.when(F.get(w, i) == "licence", F.lit("license")).otherwise(F.get(w, i)).alias("anchor"),
        F.array_join(F.slice(w, F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i, F.lit(WINDOW))), " ").alias("left"),
        F.array_join(F.slice(w, i + 2, WINDOW), " ").alias("right"),
    )
    df = df.withColumn("_near", F.transform("_at", around)).drop("_w", "_at", "_joints")
    is_base = lambda x: (x["word"] == "license") & x["left"].rlike(r"(?:^| )(?:mit|apache|general public)$")

    def base_place(x: Column) -> Column:
        label = F.when(x["left"].rlike(r"(?:^| )mit$"), F.lit("mit")).when(x["left"].rlike(r"(?:^| )apache$"), F.lit("apache")).otherwise(F.lit("gpl"))
        return F.struct((x["at"] - F.when(label == "gpl", 2).otherwise(1)).cast("long").alias("start"), label.alias("label"))

    df = df.withColumn("_base", F.coalesce(F.transform(F.filter("_near", is_base), base_place), F.array().cast("array<struct<start:bigint,label:string>>")))
    df = df.withColumn("_hits", F.expr(f"array_sort(filter(transform(_near, x -> {_detect()}), h -> h IS NOT NULL))"))
    df = df.withColumn("_hits", F.coalesce("_hits", F.array().cast(f"array<{HIT}>")))
    h = F.col("_hits")
    reach = 2 * WINDOW + 1

    def suppressed(x: Column, i: Column) -> Column:
        """Within another detection of higher priority, or of the same rule and wider, among those that can overlap."""
        around = F.slice(h, F.greatest(i + 1 - reach, F.lit(1)), 2 * reach + 1)
        inside = lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"])
        return F.exists(around, lambda y: inside(y) & ((y["rule"] < x["rule"]) | ((y["rule"] == x["rule"]) & (y["end"] - y["start"] > x["end"] - x["start"]))))

    df = df.withColumn("_kept", F.filter(h, lambda x, i: ~suppressed(x, i)))
    starts = F.transform("_base", lambda b: b["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda b: b["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("_kept", lambda k: k["label"]))))
    confidence = F.greatest(F.coalesce(F.array_max(F.transform("_kept", lambda k: k["confidence"])), F.lit(0.0)), F.when(F.size("_base") > 0, F.lit(NAME)).otherwise(F.lit(0.0)))
    return df.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        confidence.alias("score"),
        F.transform("_kept", lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"), k["label"].alias("label"), k["confidence"].alias("confidence"))).alias("detections"),
    )
