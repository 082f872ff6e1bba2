"""Secret scans: multipart credential linking, with DataFrame functions only.

A credential has parts: an access identifier, a secret, an endpoint. Some are sure by themselves (base kinds: ``assign``, ``access``,
``hex``). Weak candidates are reported only where parts that complement each other stand together:

- ``identifier`` (a user, login, client or key id that is assigned) with a secret of any kind nearby,
- ``key`` (an unlabelled token of small letters, capitals and digits) with an identifier of any kind or an endpoint nearby,
- ``endpoint`` (a URL, or a host with its port) with both a secret and an identifier nearby.

Nearby means in the same scope (text between empty lines) and at most REACH characters from start to start. This is an interval join:
parts meet by (text, scope, bin of REACH characters) and the two bins beside it. Of each bin only the first and the last start of
each role go into the join, which says exactly what is in reach, so dense bins make no pairs. Places come from
lengths of matches and of the text between them, summed up by windows within one text. Only such narrow rows are shuffled, no text.

Defined results: a null text is an empty one. Texts are told apart by two 64-bit hashes of (doc_id, text), so repeated rows and rows
without doc_id get the results of their texts. A weak ``key`` that begins inside a base span or an endpoint is part of that and not
reported. Spans are half-open, in code points, ordered by start, then by kind as in KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.expressions import compute_once
from threatloom.llm.common import documents
from threatloom.session import checkpointed

KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
BASE = 3
#: Kinds by the role that they play in a credential.
ROLES = {"secret": ("assign", "hex", "key"), "identifier": ("access", "identifier"), "endpoint": ("endpoint",)}
REACH = 400
_BREAK = len(KINDS)


def either_case(words: str) -> str:
    """A pattern for words in capitals or small letters, without flags, since engines differ in what they fold."""
    return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in words)


_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
#: A match of the right kind has a value, group 2, of LEAST_VALUE characters.
ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')}){_ASSIGNED}([A-Za-z0-9+/_.=-]+)"
LEAST_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
IDENTIFIER = f"({either_case('user_?name|user|login|client_?id|account_?id|account|access_?key_?id|key_?id')}){_ASSIGNED}([A-Za-z0-9@._+-]+)"
LEAST_IDENTIFIER = 3
KEY = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Bounded, so that a text is read in time proportional to its length.
ENDPOINT = r"[A-Za-z][A-Za-z0-9+.]{1,15}://[^\x00-\x20\x22\x27<>`{|}\x7F]+|[A-Za-z0-9-][A-Za-z0-9.-]{1,62}\.[A-Za-z]{2,8}:[0-9]{2,5}"
EMPTY_LINE = r"\n[\x20\t\r]*\n"
_PATTERNS = (ASSIGN, ACCESS, HEX, IDENTIFIER, KEY, ENDPOINT, EMPTY_LINE)
#: What a text must hold for a pattern to be tried.
_HINTS = (None, "AKIA", None, None, None, ":", "\n")


def _key(number: int) -> Column:
    first, second = (F.col("doc_id"), F.col("text")) if number == 1 else (F.col("text"), F.col("doc_id"))
    return F.xxhash64(F.lit(number), F.col("doc_id").isNull(), first, second)


def _with_keys(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumns({"k1": _key(1), "k2": _key(2)})


def _matched(kind: int) -> Column:
    pattern = F.lit(_PATTERNS[kind])
    may = F.regexp_like("text", pattern)
    if _HINTS[kind] is not None:
        may = F.contains("text", F.lit(_HINTS[kind])) & may
    return F.when(may, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))


def _entries(kind: int) -> Column:
    """(kind, i, gap, size, good) of each match: its length, that of the text before it, and whether it counts."""
    name = f"found{kind}"
    good = {
        0: lambda m, i: F.length(F.get("values0", i)) >= LEAST_VALUE,
        3: lambda m, i: F.length(F.get("values3", i)) >= LEAST_IDENTIFIER,
        4: lambda m, i: F.regexp_like(m, F.lit("[a-z]")) & F.regexp_like(m, F.lit("[A-Z]")) & F.regexp_like(m, F.lit("[0-9]")),
    }.get(kind, lambda m, i: F.lit(True))
    entry = lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(f"gaps{kind}", i)).alias("gap"), F.length(m).alias("size"), good(m, i).alias("good")
    )
    return F.transform(name, entry)


def _parts(docs: DataFrame) -> DataFrame:
    """k1, k2, kind, start, end, scope and bin of all parts, weak ones included; in the shared folder."""
    docs = compute_once(docs, **{f"found{kind}": _matched(kind) for kind in range(_BREAK)})
    weak = F.size("found3") + F.size("found4") + F.size("found5") > 0
    none = F.array().cast("array<string>")
    # Scopes matter only where something is weak.
    docs = compute_once(docs, **{f"found{_BREAK}": F.when(weak, _matched(_BREAK)).otherwise(none)})
    held = lambda kind: F.size(f"found{kind}") > 0
    between = {f"gaps{k}": F.when(held(k), F.split("text", _PATTERNS[k], -1)).otherwise(none) for k in range(_BREAK + 1)}
    values = {f"values{k}": F.when(held(k), F.regexp_extract_all("text", F.lit(_PATTERNS[k]), F.lit(2))).otherwise(none) for k in (0, 3)}
    docs = compute_once(docs, **between, **values)
    parts = docs.select("k1", "k2", F.explode(F.concat(*[_entries(k) for k in range(_BREAK + 1)])).alias("part")).select("k1", "k2", "part.*")
    parts = parts.distinct()  # repeated rows
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("k1", "k2", "kind").orderBy("i"))
    parts = parts.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("size")).where("good")
    order = Window.partitionBy("k1", "k2").orderBy("start", "kind")
    scope = F.sum(F.when(F.col("kind") == _BREAK, 1).otherwise(0)).over(order)
    solid = F.when((F.col("kind") < BASE) | (F.col("kind") == KINDS.index("endpoint")), F.col("end"))
    covered = F.max(solid).over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    parts = parts.withColumns({"scope": scope, "covered": F.coalesce(covered, F.lit(False))})
    parts = parts.where((F.col("kind") != _BREAK) & ((F.col("kind") != KINDS.index("key")) | ~F.col("covered")))
    return checkpointed(parts.select("k1", "k2", "kind", "start", "end", "scope", F.expr(f"start div {REACH}").alias("bin")))


def _linked(parts: DataFrame) -> DataFrame:
    """Weak parts with their complements in reach."""
    of = {role: F.col("kind").isin([KINDS.index(kind) for kind in kinds]) for role, kinds in ROLES.items()}
    ends = [f(F.when(has, F.col("start"))).alias(f"{name}_{role}") for role, has in of.items() for name, f in (("first", F.min), ("last", F.max))]
    bins = parts.groupBy("k1", "k2", "scope", "bin").agg(*ends)
    spread = bins.select("*", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])).alias("step")).withColumn("bin", F.col("bin") + F.col("step"))
    seen = [
        f(F.when(F.col("step") == step, F.col(f"{end}_{role}"))).alias(f"{name}_{role}")
        for role in ROLES for step, end, name, f in ((1, "last", "before", F.max), (0, "first", "here", F.min), (-1, "first", "after", F.min))
    ]
    near = spread.groupBy("k1", "k2", "scope", "bin").agg(*seen)
    found = parts.where(F.col("kind") >= BASE).join(near, ["k1", "k2", "scope", "bin"])

    def has(role: str) -> Column:
        before = F.col("start") - F.col(f"before_{role}") <= REACH
        after = F.col(f"after_{role}") - F.col("start") <= REACH
        return F.col(f"here_{role}").isNotNull() | F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    meets = {"identifier": has("secret"), "key": has("identifier") | has("endpoint"), "endpoint": has("secret") & has("identifier")}
    kept = F.lit(False)
    for kind, condition in meets.items():
        kept = kept | ((F.col("kind") == KINDS.index(kind)) & condition)
    return found.where(kept).select("k1", "k2", "kind", "start", "end")


def find_secrets(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, text, the columns of ``keep``, and spans (start, kind, end), base and linked ones."""
    docs = _with_keys(documents(df, *keep))
    parts = _parts(docs.select("k1", "k2", "text"))
    spans = parts.where(F.col("kind") < BASE).select("k1", "k2", "kind", "start", "end").unionByName(_linked(parts))
    spans = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    found = docs.join(spans, ["k1", "k2"], "left").drop("k1", "k2")
    named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.get(F.array(*map(F.lit, KINDS)), s["kind"]).alias("kind"), s["end"].alias("end")))
    return found.withColumn("spans", F.coalesce(named, F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")))


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def is_base(span: Column) -> Column:
    return span["kind"].isin(*KINDS[:BASE])
