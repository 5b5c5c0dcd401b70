"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns are reported wherever they stand. Weak ones (something that
looks like a bare key, a user name, an address of a service) mean little
alone; they are reported only where the parts complete each other within a
scope: an identifier or an endpoint near a secret. The linking is an interval
join inside the row: spans of one document against an index of its other spans
by place, so no text is shuffled and the work of a task follows the length of
its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.arrays import any_near, captured, spans_within, with_index, with_running
from panelspark.llm.common import text_of

# The strong patterns and the least lengths of what they must match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
ACCESS_LENGTH = 18
HEX_LENGTH = 16
#: A run of such characters is found whole, so asking for the length in the pattern finds the same spans.
ACCESS = rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}"
HEX = rf"[0-9a-f]{{{HEX_LENGTH},}}"

# Weak patterns.
IDENTIFIER = r"""(?i)(?<![a-z0-9_])(?:client_?id|access_?key_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
KEY_LENGTH = 40
_RUN = "A-Za-z0-9+/_-"
_MIXED = "".join(f"(?=[{_RUN}]*[{c}])" for c in ("0-9", "A-Z", "a-z"))
_WORD = "(?:(?:[A-Z]?[a-z]{2,}+)++[0-9]*+|[A-Z]++[0-9]*+|[A-Za-z]|[0-9]++)"
#: What looks like a bare key: a whole run of 40 mixed characters of base64, or one of 20 and more that may be
#: URL-safe too, padding included; a "=" may stand before. Of the second kind, paths after a host, embedded data
#: and runs of plain words and numbers (slugs, paths) are none.
SECRET = (
    rf"(?<![{_RUN}]){_MIXED}(?:[A-Za-z0-9+/]{{{KEY_LENGTH}}}(?![{_RUN}])"
    rf"|(?<!base64,)(?!(?<=\.)[a-z]{{2,}}/)(?!(?<=:)//)(?![/_-]*+{_WORD}(?:[/_-]++{_WORD})++[/_-]*+(?![{_RUN}]))[{_RUN}]{{20,}}+)={{0,2}}+(?![={_RUN}])"
)
ENDPOINT = r"""(?i)(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ftp|jdbc:[a-z0-9]+)://[^\s"'<>]+|(?<![a-z0-9_])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}"""
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
STRONG = KINDS[:3]
#: Parts complete each other if at most so many code points lie between them.
SCOPE = 200
#: Code points of a text that are masked together.
PIECE = 4_096

SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def with_places(df: DataFrame, text: Column, patterns: dict[str, tuple[str, int, int]], gates: dict[str, Column]) -> DataFrame:
    """df plus ``_kind`` for each kind: places of the leftmost non-overlapping matches, in code points, end exclusive.

    Spark has no function for the places of all matches, but the pieces between
    them (split) and the matches themselves give every place by adding lengths.
    patterns: kind to (pattern, group, least); matches whose group is shorter
    than ``least`` are dropped afterwards.
    """

    def cut(kind: str) -> Column:
        pattern, group, least = patterns[kind]
        enough = (lambda f: F.length(F.regexp_extract(f, pattern, group)) >= least) if least else (lambda f: f.isNotNull())
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        lengths = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("f")), lambda x: F.struct(F.length(x["p"]).cast("long").alias("p"), F.length(x["f"]).cast("long").alias("f"), enough(x["f"]).alias("ok")))
        return F.when(gates[kind], lengths).otherwise(F.array().cast("array<struct<p:bigint,f:bigint,ok:boolean>>"))

    def places(kind: str) -> Column:
        place = lambda x, at: F.struct((at + x["p"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (at + x["p"] + x["f"]).alias("end"), F.lit(kind).alias("kind"), x["ok"].alias("ok"))
        good = F.filter(F.zip_with(f"_cut_{kind}", f"_from_{kind}", place), lambda x: F.coalesce(x["ok"], F.lit(False)) & x["end"].isNotNull())
        return F.transform(good, lambda x: x.dropFields("ok")).cast(SPAN)

    df = df.withColumns({f"_cut_{k}": cut(k) for k in patterns})
    df = df.withColumns({f"_step_{k}": F.transform(f"_cut_{k}", lambda x: x["p"] + F.coalesce(x["f"], F.lit(0))) for k in patterns})
    df = with_running(df, {f"_step_{k}": f"_from_{k}" for k in patterns}, lambda a, b: a + b)
    return df.withColumns({f"_{k}": places(k) for k in patterns}).drop(*[f"_{x}_{k}" for k in patterns for x in ("cut", "step", "from")])


def apart(part: Column, secret: Column, text: Column) -> Column:
    """Whether they are two parts: the value of an identifier or a piece of an address does not complete it.

    Keys of 40 characters, strong secrets and passwords before a host count wherever they stand.
    """
    inside = (part["start"] <= secret["start"]) & (part["end"] >= secret["end"])
    return ~inside | (secret["kind_no"] != KINDS.index("secret")) | (secret["end"] - secret["start"] == KEY_LENGTH) | (F.substring(text, (secret["end"] + 1).cast("int"), F.lit(1)) == "@")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with ``_spans``: all reported spans by start, then kind."""
    text = text_of()
    df = docs
    gates = {
        "assign": text.rlike(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
        "access": F.instr(text, "AKIA") > 0,
        "hex": text.rlike(HEX),
        "identifier": text.rlike(IDENTIFIER),
        "secret": text.rlike(SECRET),
        "endpoint": text.rlike(ENDPOINT),
    }
    patterns = {"assign": (ASSIGN, 2, ASSIGN_LENGTH), "access": (ACCESS, 0, 0), "hex": (HEX, 0, 0), "identifier": (IDENTIFIER, 0, 0), "secret": (SECRET, 0, 0), "endpoint": (ENDPOINT, 0, 0)}
    df = with_places(df, text, patterns, gates)
    col = {k: F.col(f"_{k}") for k in KINDS}
    groups = {"_secrets": ("assign", "hex", "secret"), "_ids": ("access", "identifier"), "_parts": ("access", "identifier", "endpoint")}
    df = df.withColumns({name: F.array_sort(F.concat(*[col[k] for k in kinds])) for name, kinds in groups.items()})
    df = with_index(df, {name: f"{name}_by_place" for name in groups}).drop(*groups)
    secrets, ids, parts = (F.col(f"{g}_by_place") for g in groups)
    near = lambda x, index, also=None: any_near(index, x["start"], x["end"], scope, also)
    # The complement of a weak secret is an identifier or an endpoint; of these two, a secret.
    weak = {
        "_weak_secret": captured(parts, F.filter(col["secret"], lambda x: near(x, parts, lambda o: apart(o, x, text)))),
        "_weak_identifier": captured(secrets, F.filter(col["identifier"], lambda x: near(x, secrets, lambda o: apart(x, o, text)))),
        "_weak_endpoint": captured(secrets, captured(ids, F.filter(col["endpoint"], lambda x: near(x, secrets, lambda o: apart(x, o, text)) & near(x, ids)))),
    }
    df = df.withColumns(weak)
    everything = F.array_sort(F.concat(*[col[k] for k in STRONG], F.col("_weak_identifier"), F.col("_weak_secret"), F.col("_weak_endpoint")))
    return df.withColumn("_spans", everything).drop(*[f"_{k}" for k in KINDS], *[f"{g}_by_place" for g in groups], "_weak_secret", "_weak_identifier", "_weak_endpoint")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans): spans is an array of (start, kind_no, end, kind).

    One row for each row of docs, repeated ones too; none of an empty table. A
    null or empty text has an empty array; a null doc_id stays null. Only doc_id and text are read.
    Where spans start together, they stand in the order of ``KINDS``.
    """
    return with_spans(docs.select("doc_id", "text"), scope).select("doc_id", F.col("_spans").alias("spans"))


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of :func:`scan`."""
    found = scan(docs, scope)
    strong = F.filter("spans", lambda s: s["kind_no"] < len(STRONG))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in STRONG], F.sha2(digest(strong), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """docs, with the same columns, where each stretch of reported spans became ``mask``.

    n_chars, if there, follows the text. Texts without findings, null ones
    included, stay as they are; an empty table gives an empty one. A text is
    masked in pieces of ``PIECE`` code points, each with the stretches in it.
    """
    df = with_spans(docs, scope).withColumn("_ends", F.transform("_spans", lambda x: x["end"]))
    df = with_running(df, {"_ends": "_before"}, F.greatest)
    first = F.filter(F.zip_with("_spans", "_before", lambda x, at: F.struct(x["start"].alias("start"), at.alias("at"))), lambda x: x["start"] >= x["at"])
    df = df.withColumn("_first", first)
    # A stretch ends where all spans up to the next stretch have.
    after = F.concat(F.transform(F.slice("_first", 2, F.greatest(F.size("_first"), F.lit(1))), lambda x: x["at"]), F.array(F.array_max("_ends")))
    df = df.withColumn("_stretches", F.zip_with("_first", after, lambda x, end: F.struct(x["start"].alias("start"), end.alias("end"))))
    df = with_index(df, {"_stretches": "_index"})
    dirty, index = F.size("_spans") > 0, F.col("_index")
    df = df.withColumn("_pieces", F.when(dirty, F.regexp_extract_all(text_of(), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def masked(piece: Column, no: Column) -> Column:
        low = no.cast("long") * PIECE
        part = lambda a, b: F.substring(piece, (a - low + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
        start = F.struct(low.alias("at"), F.lit("").alias("out"))
        step = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], part(s["at"], x["start"]), F.when(x["start"] >= low, F.lit(mask)).otherwise("")).alias("out"))
        return F.aggregate(spans_within(index, low, low + PIECE), start, step, lambda s: F.concat(s["out"], part(s["at"], low + PIECE)))

    df = df.withColumn("text", F.when(dirty, F.array_join(captured(index, F.transform("_pieces", masked)), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(dirty, F.length("text").cast("long")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)
