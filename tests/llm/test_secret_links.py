"""Secret spans against plain loops: linking, redaction, and texts with very many spans."""

import random
import re
import time

from pyspark.sql import functions as F

from panelspark.llm import arrays, secret_scan
from tests.llm.helpers import EDGES, docs

S = secret_scan
PATTERNS = {"assign": (S.ASSIGN, 2, S.ASSIGN_LENGTH), "access": (S.ACCESS, 0, 0), "hex": (S.HEX, 0, 0), "identifier": (S.IDENTIFIER, 0, 0), "secret": (S.SECRET, 0, 0), "endpoint": (S.ENDPOINT, 0, 0)}


def plain_spans(text):
    """All reported spans by comparing every span with every other."""
    found = {k: [(m.start(), S.KINDS.index(k), m.end(), k) for m in re.finditer(p, text, re.A) if len(m[g]) >= least] for k, (p, g, least) in PATTERNS.items()}
    near = lambda x, o: o[0] <= x[2] + S.SCOPE and o[2] >= x[0] - S.SCOPE

    def apart(part, secret):
        inside = part[0] <= secret[0] and part[2] >= secret[2]
        return not inside or secret[3] != "secret" or secret[2] - secret[0] == S.KEY_LENGTH or text[secret[2] : secret[2] + 1] == "@"

    secrets, ids = found["assign"] + found["hex"] + found["secret"], found["access"] + found["identifier"]
    out = found["assign"] + found["access"] + found["hex"]
    out += [x for x in found["secret"] if any(near(x, o) and apart(o, x) for o in ids + found["endpoint"])]
    out += [x for x in found["identifier"] if any(near(x, o) and apart(x, o) for o in secrets)]
    out += [x for x in found["endpoint"] if any(near(x, o) and apart(x, o) for o in secrets) and any(near(x, o) for o in ids)]
    return sorted(out)


def plain_redaction(text):
    out, at = [], 0
    for start, _, end, _ in plain_spans(text):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mixed(seed, n):
    """Parts of all kinds, near each other and far apart, among words of one to four bytes a character."""
    rng = random.Random(seed)
    key = lambda k: "aZ9" + "".join(rng.choice("abcXYZ012789") for _ in range(k - 3))
    parts = [
        lambda: f"user: bob{rng.randrange(99)}", lambda: f"token='{key(20)}'", lambda: "AKIA" + key(18).upper(), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(10, 50))), lambda: key(rng.choice((20, 40, 41, 64))),
        lambda: f"https://db{rng.randrange(9)}.example.com/x?sig={key(40)}", lambda: f"host = h{rng.randrange(999)}.local", lambda: f"postgres://bob:{key(24)}@db/x", lambda: "password=secret=" + key(22), lambda: "ünï 世界🙂 " * rng.randrange(1, 60), lambda: "plain words\n" * rng.randrange(1, 30),
    ]
    return " ".join(rng.choice(parts)() for _ in range(n))


def test_links_and_redaction_match_plain_loops(spark):
    table = [(i, mixed(i, 3 + 7 * i)) for i in range(24)] + [(50, mixed(99, 900))] + [(100 + i, t or "") for i, (_, t) in enumerate(EDGES)]
    df = docs(spark, table)
    got = {r["doc_id"]: [(s["start"], s["kind_no"], s["end"], s["kind"]) for s in r["spans"]] for r in S.scan(df).collect()}
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in S.redact(df).collect()}
    for i, t in table:
        assert got[i] == plain_spans(t), i
        assert clean[i] == (plain_redaction(t), len(plain_redaction(t))), i


def test_two_hundred_thousand_spans_take_seconds(spark):
    rng = random.Random(1)
    one = lambda i: f"{rng.getrandbits(128):032x} user: u{i}" if i % 2 else f"{rng.getrandbits(128):032x}"
    text = "\n".join(one(i) for i in range(134_000))
    began = time.time()
    r = S.report(docs(spark, [(1, text)])).select("n_hex", F.length("spans").alias("n")).first()
    assert r["n_hex"] == 134_000 and time.time() - began < 60
    began = time.time()
    assert S.redact(docs(spark, [(1, text)])).select(F.length("text")).first()[0] < len(text) and time.time() - began < 90


def test_running_values_over_blocks_of_blocks(spark):
    sizes = (0, 1, 2, 63, 64, 65, 4095, 4096, 4097, 9000)
    rng = random.Random(2)
    rows = [(i, [rng.randrange(100) for _ in range(n)]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, x array<bigint>")
    sums = arrays.with_running(df, {"x": "s"}, lambda a, b: a + b)
    tops = arrays.with_running(sums, {"x": "m"}, F.greatest)
    for r in tops.collect():
        total, top, want = 0, 0, ([], [])
        for v in rows[r["i"]][1]:
            want[0].append(total)
            want[1].append(top)
            total, top = total + v, max(top, v)
        assert (r["s"], r["m"]) == want
