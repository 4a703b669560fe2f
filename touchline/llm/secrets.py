"""Secret scans in DataFrame functions only.

Base spans come from three fixed patterns. ``split`` and ``regexp_extract_all``
with one pattern give the text between its matches and the matches, so running
sums of lengths give code-point offsets.

Entropy spans are added to them: candidate strings are runs of token
characters that hold a digit and a letter; a window slides over each, the
counts of its characters are updated by the one that enters and the one that
leaves, and the greatest Shannon entropy of a window is compared with the
bound of the candidate's character class. Candidates that fit an allow-list
pattern are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns. Letters of the keywords match in either case.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
          r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Least code points of group 2 of an assignment, and of an access key.
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Candidate strings: runs of token characters with a digit and a letter.
CANDIDATE = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})(?=[A-Za-z+/_=-]*+[0-9])"
             r"(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]++")
WINDOW = 20
#: Entropy bounds in bits a character, by class.
HEX_BITS, ALNUM_BITS, TOKEN_BITS = 3.0, 3.6, 3.8
#: Candidates that are no secrets: counting digits or letters, UUIDs, dates,
#: words joined by signs (a short number may end them), paths, placeholders.
ALLOW = (
    r"^(0123456789|1234567890|abcdefghij)",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^[A-Za-z_/+=-]*[_/+=-][A-Za-z]*[0-9]{0,4}$",
    r"(?i)example|sample|placeholder|changeme|xxxx",
)
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_SPANS = "array<struct<start:int,end:int,kind:int,text:string>>"
#: Matches of a text are gathered in parts of this many, so long lists are not copied at every step.
_PART = 256


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as structs (start, end, kind, text), leftmost, not overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def spans(both: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.element_at(both["gaps"], i + 1)
            own = F.element_at(both["found"], i + 1)
            end = start + F.length(own)
            span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), own.alias("text")))
            full = F.size(state["part"]) >= _PART
            return F.struct(end.alias("at"), F.when(full, span).otherwise(F.concat(state["part"], span)).alias("part"),
                            F.when(full, F.concat(state["parts"], F.array(state["part"]))).otherwise(state["parts"]).alias("parts"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("part"), F.array().cast(f"array<{_SPANS}>").alias("parts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(both["found"]) - 1), start, step,
                           lambda s: F.flatten(F.concat(s["parts"], F.array(s["part"]))))

    return F.when(text.rlike(pattern), _let(F.struct(found.alias("found"), gaps.alias("gaps")), spans)).otherwise(F.array().cast(_SPANS))


def _peak_entropy(token: Column, window: int) -> Column:
    """Greatest entropy (bits) over windows of a token, by incremental counts.

    ``counts`` has one cell per sign; ``sum`` is the sum of c * log2(c), which
    a move changes in the two cells of the leaving and the entering sign only.
    """
    def term(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))

    def over(cells: Column) -> Column:
        zero = F.array_repeat(F.lit(0), len(_SIGNS))
        size = F.least(F.size(cells), F.lit(window))

        def step(state: Column, i: Column) -> Column:
            enters = F.element_at(cells, i)
            leaves = F.when(i > window, F.element_at(cells, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            counts = F.transform(state["counts"], lambda c, j: c + F.when(j + 1 == enters, 1).otherwise(0)
                                 - F.when(j + 1 == leaves, 1).otherwise(0))
            up, down = F.element_at(state["counts"], enters), F.element_at(state["counts"], F.greatest(leaves, F.lit(1)))
            total = F.when(enters == leaves, state["sum"]).otherwise(
                state["sum"] + term(up + 1) - term(up)
                + F.when(leaves > 0, term(down - 1) - term(down)).otherwise(F.lit(0.0)))
            bits = F.log2(size.cast("double")) - total / size
            return F.struct(counts.alias("counts"), total.alias("sum"),
                            F.when(i >= size, F.greatest(state["peak"], bits)).otherwise(state["peak"]).alias("peak"))

        start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"))
        return F.aggregate(F.sequence(F.lit(1), F.size(cells)), start, step, lambda s: s["peak"])

    return _let(F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(_SIGNS))), over)


def _class_bits(token: Column) -> Column:
    return (F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), F.lit(HEX_BITS))
            .when(token.rlike("^[A-Za-z0-9]+$"), F.lit(ALNUM_BITS)).otherwise(F.lit(TOKEN_BITS)))


def _suspicious(token: Column, window: int) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | token.rlike(pattern)
    return ~allowed & (_peak_entropy(token, window) > _class_bits(token))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, base, added``: arrays of structs (start, kind, end, text) in
    code points, end exclusive; kinds 0 assign, 1 access, 2 hex, 3 entropy.

    A null or empty text has none. ``base`` is sorted by start, then kind.
    ``added`` holds entropy spans outside the base spans, by start. One
    row per input row; repeated rows repeat.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (rows.withColumn("base", base_spans(F.col("text")))
            .select("doc_id", "base", entropy_spans(F.col("text"), F.col("base"), window).alias("added")))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns of a text without nulls, by start, then kind."""
    assign = F.filter(_matches(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_LEAST)
    access = F.filter(_matches(text, ACCESS, 1), lambda s: F.length(s["text"]) >= ACCESS_LEAST)
    keyed = F.transform(F.concat(assign, access, _matches(text, HEX, 2)), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text")))
    return F.sort_array(keyed)


def _uncovered(c: Column, base: Column, window: int) -> Column:
    """The parts of a candidate that no base span covers. A cut part loses the
    signs at the cut and must be a candidate by itself."""
    def part(start: Column, end: Column) -> Column:
        own = F.substring(c["text"], start - c["start"] + 1, end - start)
        lead = F.when(start > c["start"], F.length(F.regexp_extract(own, "^[+/_=-]*", 0))).otherwise(0)
        tail = F.when(end < c["end"], F.length(F.regexp_extract(own, "(?<![+/_=-])[+/_=-]*$", 0))).otherwise(0)
        size = F.greatest(F.length(own) - lead - tail, F.lit(0))
        return F.struct((start + lead).alias("start"), (start + lead + size).alias("end"), c["kind"].alias("kind"),
                        F.substring(own, lead + 1, size).alias("text"))

    def step(state: Column, b: Column) -> Column:
        free = F.when(b["start"] > state["at"], F.array(part(state["at"], b["start"]))).otherwise(F.array().cast(_SPANS))
        return F.struct(F.greatest(state["at"], b["end"]).alias("at"), F.concat(state["parts"], free).alias("parts"))

    def last(state: Column) -> Column:
        return F.when(state["at"] < c["end"], F.concat(state["parts"], F.array(part(state["at"], c["end"])))).otherwise(state["parts"])

    def cut(touching: Column) -> Column:
        start = F.struct(c["start"].alias("at"), F.array().cast(_SPANS).alias("parts"))
        parts = F.filter(F.aggregate(touching, start, step, last), lambda s: (F.length(s["text"]) >= window) & s["text"].rlike("[0-9]")
                         & s["text"].rlike("[A-Za-z]"))
        return F.when(F.size(touching) > 0, parts).otherwise(F.array(c))

    return _let(F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])), cut)


def entropy_spans(text: Column, base: Column, window: int = WINDOW) -> Column:
    """Spans of candidates, less what base spans cover, whose entropy is high, by start."""
    def free(both: Column) -> Column:
        return F.flatten(F.transform(both["c"], lambda c: _uncovered(c, both["b"], window)))

    apart = _let(F.struct(base.alias("b"), _matches(text, CANDIDATE, 3).alias("c")), free)
    return F.transform(F.filter(apart, lambda s: _suspicious(s["text"], window)), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text")))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(n) for n in ("assign", "access", "hex", "entropy")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(docs: DataFrame) -> DataFrame:
    found = scan(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", window: int = WINDOW) -> DataFrame:
    """The table with every found span of ``text_col`` replaced by ``mark``
    (overlapping spans are one). Null texts stay null, other columns stay."""
    text, base, spans = F.col(text_col), "_secret_base", "_secret_spans"

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    cut = F.aggregate(F.col(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                      lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    whole = F.coalesce(text, F.lit(""))
    return (docs.withColumn(base, base_spans(whole))
            .withColumn(spans, F.sort_array(F.concat(F.col(base), entropy_spans(whole, F.col(base), window))))
            .withColumn(text_col, F.when(F.size(spans) > 0, cut).otherwise(text)).drop(base, spans))
