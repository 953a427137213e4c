"""Repair of conversation structure: the cheapest edits that make turns alternate, by dynamic
programming over whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, staged, tidied

VISIBLE = r"[^\x20\x09-\x0D]"
LAST_VISIBLE = r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"
# Costs of the edits, and what a truncated turn that stays adds.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
# Edit letters in ASCII order, as octal digits from 1; 0 pads the end.
LETTERS = "DIKR"
DIGIT = 3  # bits
# Initials written so far, as a pattern `(s?(ua)+)?`: nothing, s, an open u, closed.
START, SYSTEM, OPEN, CLOSED = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): OPEN, (SYSTEM, "u"): OPEN, (OPEN, "a"): CLOSED, (CLOSED, "u"): OPEN}
ROLE = {"u": "user", "a": "assistant"}
# A turn's code: its role's initial (other for none of the three), or'ed with its fault.
INITIALS = "sua"
OTHER = 3
MUST_GO, TRUNCATED = 4, 8


def cheapest(codes: bytes) -> tuple[int, str]:
    """Least cost and edit letters of a conversation's turn codes; of equal costs the letters
    that come first in ASCII order.

    A path's weight is one whole number: the cost in its high digits, below it one octal digit
    for each letter, first letter highest, zeros behind the last. The least weight from each
    (turn, state) to the end is an ordinary minimum over that node's edges: an edge puts its
    letter before the rest's, whose digits move down by one place (there is room for all), and
    adds its cost. Insertions lead from state to state before the same turn, two at most in a
    row, as two more would lead back at a price.

    Time is the number of turns times their digits' length in machine words.
    """
    places = 2 * len(codes) + 4
    unit = DIGIT * places                     # cost 1 is 1 << unit
    low = (1 << unit) - 1
    lead = [(k + 1) << (unit - DIGIT) for k in range(4)]
    d, i, k, r = lead

    def edge(rest, cost, letter):
        return None if rest is None else ((rest >> unit) + cost << unit) + letter + ((rest & low) >> DIGIT)

    def inserted(best):
        for _ in range(2):
            best = [min((w for w in (best[s], *(edge(best[NEXT[s, x]], INSERT, i) for x in "ua" if (s, x) in NEXT))
                         if w is not None), default=None) for s in range(4)]
        return best

    best = inserted([0, None, None, 0])       # the end: nothing at all, or closed
    for code in reversed(codes):
        initial = INITIALS[code & 3] if code & 3 != OTHER else None
        extra = CUT_SHORT if code & TRUNCATED else 0
        here = []
        for s in range(4):
            ways = [edge(best[s], DELETE, d)]
            if not code & MUST_GO:
                if (s, initial) in NEXT:
                    ways.append(edge(best[NEXT[s, initial]], KEEP + extra, k))
                ways += [edge(best[NEXT[s, x]], REROLE + extra, r) for x in "ua" if (s, x) in NEXT]
            here.append(min((w for w in ways if w is not None), default=None))
        best = inserted(here)
    return best[START] >> unit, oct(best[START] & low)[2:].zfill(places).rstrip("0").translate(
        str.maketrans("1234", LETTERS))


class Repair:
    """The edits of one conversation, applied to its turns as they are fed one at a time. The
    letters say which role: one that is not kept is the one that the state asks for."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def after(self, turn: tuple[str, str] | None) -> Iterator[tuple[str, str]]:
        """Repaired turns up to and with this one; of ``None``, the insertions that are left."""
        while self.at < len(self.audit):
            letter = self.audit[self.at]
            if letter != "I" and turn is None:
                return
            self.at += 1
            if letter != "D":
                role, text = turn if letter != "I" else ("", "")
                if letter != "K":
                    role = ROLE["a" if self.state == OPEN else "u"]
                self.state = NEXT[self.state, role[0]]
                yield role, text
            if letter != "I":
                return


def _faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, code)`` of every turn: thin rows, without the texts."""
    # 64 bits would do for the order, but equal digests must mean equal texts
    thin = rows.select("conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
                       F.regexp_extract("text", LAST_VISIBLE, 1).alias("mark"))
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(*order())
    initial = F.substring("role", 1, 1)
    code = (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
            + F.when((F.col("mark") == "") | (F.col("nth") > 1), MUST_GO)
            .when(~F.col("mark").isin(".", "!", "?"), TRUNCATED).otherwise(0))
    return (thin.withColumn("nth", F.row_number().over(seen))
            .select("conv_id", "turn", "role", "digest", code.cast("int").alias("code"), (F.col("mark") == "").alias("blank")))


def order(role: str = "role", digest: str = "digest") -> list[Column]:
    """Turns of a conversation in order: by turn, nulls first; equal turns by role and digest."""
    return [F.col("turn").asc_nulls_first(), F.col(role), F.col(digest)]


FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _diagnoses(batches):
    """Sorted thin rows -> one row per conversation; a conversation is held as a byte a turn."""
    import pyarrow as pa

    names = [f.split()[0] for f in FOUND.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()]
    known: dict[bytes, tuple[int, str]] = {}
    out: list[tuple] = []
    now: tuple | None = None   # (conv_id,) of the open conversation
    codes = bytearray()
    n = {}

    def start():
        codes.clear()
        n.update(low=None, high=None, turns=0, blank=0, duplicate=0, truncated=0, illegal=0, last=None)

    def close():
        key = bytes(codes)
        found = known.get(key)
        if found is None:
            found = cheapest(key)
            if len(key) <= 24 and len(known) < 200_000:
                known[key] = found
        gaps = 0 if n["low"] is None else n["high"] - n["low"] + 1 - n["turns"]
        return (*now, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], *found)

    def flushed():
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "code", "blank")]
        for conv, turn, role, code, blank in zip(*cols):
            if now != (conv,):
                if now is not None:
                    out.append(close())
                now = (conv,)
                start()
            if turn is not None:
                n["low"] = turn if n["low"] is None else n["low"]
                n["turns"] += turn != n["high"]
                n["high"] = turn
            n["blank"] += blank
            n["duplicate"] += bool(code & MUST_GO and not blank)
            n["truncated"] += bool(code & TRUNCATED)
            if n["last"] is not None:
                n["illegal"] += n["last"] + role[:1] not in ("su", "ua", "au")
            n["last"] = role[:1]
            codes.append(code)
            if len(out) >= 1000:
                yield flushed()
                out = []
    if now is not None:
        out.append(close())
    if out:
        yield flushed()


def filled(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with null roles and texts as one blank."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def diagnose(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``gaps`` in the turn numbers, turns that are ``blank``,
    ``duplicate`` or ``truncated`` (a turn's first fault counts), ``illegal`` neighbours of roles,
    and the ``cost`` and letters (``audit``) of the cheapest edits that give a legal conversation.

    Texts stay in the scan; thin rows move twice, once to number equal turns of a conversation,
    once to bring its turns together in order, where each is one byte. The dynamic programme
    takes a conversation from its end. A very long conversation is one task's work, a byte a
    turn; its time grows with the square of its turns over a machine word (43 s for 50,000).

    Defined cases: null roles and texts are one blank (an illegal initial, a blank turn), null
    turns come first and make no gap, rows with a null conv_id are one conversation; rows with the
    same turn are ordered by role and text digest, and a repeated row is a duplicate; an empty
    role can't be kept; an empty table gives no rows; other columns are not read.
    """
    prepare(conversations.sparkSession)
    return (_faults(filled(conversations)).repartition("conv_id").sortWithinPartitions("conv_id", *order())
            .select("conv_id", "turn", "role", "code", "blank").mapInArrow(tidied(_diagnoses), FOUND))


def _applied(batches):
    """A conversation's audit and then its turns, sorted -> its repaired turns, streamed."""
    import pyarrow as pa

    now, edits, pos = None, None, 0
    for batch in batches:
        out: list[tuple] = []
        for conv, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is None:
                turns = edits.after((role, text))
            else:
                turns = edits.after(None) if edits else ()
            for t in turns:
                out.append((now, pos, *t))
                pos += 1
            if audit is not None:
                now, edits, pos = conv, Repair(audit), 0
        if out:
            yield _turn_batch(pa, out)
    if edits and (out := [(now, pos + i, *t) for i, t in enumerate(edits.after(None))]):
        yield _turn_batch(pa, out)


def _turn_batch(pa, out):
    cols = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                      ["conv_id", "pos", "role", "text"])


def repair(conversations: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """``(conv_id, pos, role, text)``: the turns after the edits of :func:`diagnose` on the same
    table. A conversation's rows lie together, in order of ``pos``, in one partition.

    Texts move once. A conversation's audit is sorted before its turns, which then stream past it,
    so a conversation of any length needs its audit and one Arrow batch.

    Defined cases: those of :func:`diagnose`; a conversation of which nothing stays has no rows.
    """
    prepare(conversations.sparkSession)
    rows = filled(conversations).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    both = (diagnoses.select("conv_id", F.lit(0).alias("kind"), "audit")
            .unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True))
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order())
            .select("conv_id", "audit", "role", "text")
            .mapInArrow(tidied(_applied), "conv_id long, pos long, role string, text string"))


def _hashes(batches):
    import hashlib

    import pyarrow as pa

    now, hasher, out = None, None, []

    def flushed():
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())],
                                          ["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if now != (conv,):
                if now is not None:
                    out.append((*now, hasher.hexdigest()))
                now, hasher = (conv,), hashlib.sha256()
            else:
                hasher.update(b"\n")
            hasher.update(f"{role}:{text}".encode())
        if out:
            yield flushed()
            out = []
    if now is not None:
        out.append((*now, hasher.hexdigest()))
        yield flushed()


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of :func:`repair`'s rows as they lie: ``role:text``, joined by
    newlines, streamed through the hash. Conversations without rows have none."""
    return repaired.mapInArrow(_hashes, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The table with the faults that crc32(``conv_id:turn``) mod 20 deals (nulls as one blank):
    0 drops a row, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4 makes it a user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = filled(conversations).withColumn("luck", F.crc32(key.cast("binary")) % 20).where("luck <> 0")
    text = F.when(F.col("luck") == 1, "").when(F.col("luck") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("luck") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("luck") == 3, 2).otherwise(1))
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy"))
            .drop("copy"))
