"""Repair of the structure of conversations: faults, and the cheapest edits that mend them.

Rows are damaged by a rule first (`damaged`), so that there is something to mend. Then the
rows of a conversation, by turn with nulls first, get their first fault: `blank` (no character
but white space), `duplicate` (role and text seen earlier in the conversation) or `truncated`
(the last character that is no white space is none of `.!?`). The edits and their costs are
those of `transfer`: rows are kept, given the role user or assistant, or deleted, and empty
rows may be inserted, until the initials of the roles read `(s?(ua)+)?`.

How it runs. Equal rows of a turn are counted before anything moves. Which rows repeat earlier
ones is found from (conversation, role, hash) alone. All rows are then sorted across the
cluster by conversation and turn, so a conversation of any size is spread over tasks, and
each task cuts its rows into pieces of bounded size. A conversation that lies within one
piece is settled there, by a grammar that all conversations of the task share. Pieces of
others return the matrix of their rows; these are multiplied in groups of bounded number, and
the whole audit goes back to the pieces, which write their repaired lines. The one step that
has to follow a whole conversation in order is its SHA-256, and it streams those lines.

Defined cases: a null role or text is one space, a null conv_id or turn is one space in the
rule's key; rows without a conv_id are one conversation, whose conv_id stays null. Rows of
one turn follow by role, then by SHA-256 of the text, so results do not depend on the order
of the table; equal rows count as often as they occur. A role of other letters than s, u or a
in front must be changed or deleted. Conversations without a row after the damage have zeros,
an empty audit and the hash of the empty string; an empty table gives an empty result. The
audit of a conversation must fit one value, and the eleven audits that compete for it one
task: about 11 bytes a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm import transfer
from docledger.llm.common import sent_if_small, staged, tidy

SPACES = " \t\n\x0b\x0c\r"
#: Rows and characters of a piece; conversations settled together; matrices multiplied at once.
PIECE_ROWS, PIECE_CHARS, TOGETHER, FAN = 2048, 1 << 20, 1024, 64
#: Distinct sequences whose repair a task remembers.
REMEMBERED = 20_000
LEGAL = ("su", "ua", "au")
GROUP = ["absent", "conv"]
ROW = [*GROUP, "timeless", "at", "role", "hash"]


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after the damage, with `copies`, 0 for a dropped row, whose role and text are empty.

    The fate of a row is the CRC-32 of `conv_id:turn` by 20: 0 drops it, 1 empties its text,
    2 removes the ends of its sentences, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    fate = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), fate.alias("fate")).select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 0, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") <= 1, "")
        .when(F.col("fate") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def counted(rows: DataFrame) -> DataFrame:
    """One row for equal rows: keys without nulls, role, text, its hash, and how often."""
    kind = rows.schema["conv_id"].dataType
    return (
        rows.select(
            F.col("conv_id").isNull().alias("absent"),
            F.coalesce("conv_id", F.lit(0).cast(kind)).alias("conv"),
            F.col("turn").isNull().alias("timeless"),
            F.coalesce("turn", F.lit(0)).alias("at"),
            "role",
            "text",
            "copies",
        )
        .groupBy(*GROUP, "timeless", "at", "role", "text")
        .agg(F.sum("copies").alias("copies"))
        .withColumn("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """Add `repeat`: role and text occur in an earlier turn of the conversation.

    Rows meet their own key alone, turn included, so no text that a conversation holds many
    times draws its rows into one task. Only later occurrences go back to the texts.
    """
    narrow = rows.filter("copies > 0").select(*ROW)
    first = F.min(F.struct((~F.col("timeless")).alias("timed"), F.col("at").alias("at"))).alias("first")
    firsts = narrow.groupBy(*GROUP, "role", "hash").agg(first).select(
        *GROUP, (~F.col("first.timed")).alias("timeless"), F.col("first.at").alias("at"), "role", "hash"
    )
    later = staged(narrow.join(firsts, ROW, "left_anti"), "repeated-rows").withColumn("repeat", F.lit(True))
    return rows.join(sent_if_small(later, 128), ROW, "left").withColumn(
        "repeat", F.coalesce("repeat", F.lit(False))
    )


def in_order() -> list[Column]:
    """By conversation, then by turn with nulls first."""
    return [F.col("absent"), F.col("conv"), F.col("timeless").desc(), F.col("at"), F.col("role"), F.col("hash")]


@dataclass
class Piece:
    """Rows of one conversation that follow each other."""

    roles: list[str] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    symbols: list[int] = field(default_factory=list)
    chars: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None

    def add(self, role: str, text: str, seen: bool) -> None:
        bare = text.rstrip(SPACES)
        if not bare:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        gone = seen or not bare
        unended = not gone and bare[-1] not in ".!?"
        self.truncated += unended
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.roles.append(role)
        self.texts.append(None if gone else text)
        self.symbols.append(transfer.GONE if gone else transfer.symbol(role, unended))
        self.chars += 0 if gone else len(text)

    def met(self, turn: int | None) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn


def repaired_lines(roles: list[str], texts: list[str | None], audit: str, state: int) -> list[str]:
    """The lines that the edits of `audit` leave of some rows, from a state of the automaton."""
    lines, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        asked = "assistant" if state == 2 else "user"
        if edit == "I":
            lines.append(f"{asked}:")
        else:
            role = roles[at] if edit == "K" else asked
            lines.append(f"{role}:{texts[at]}")
            asked = role
            at += 1
        state = transfer.STEPS[state][asked[0]]
    return lines


def state_behind(lines: int, opened: bool) -> int:
    """The state after so many lines; `opened` if the first of all is no user or assistant."""
    if not lines:
        return 0
    if opened and lines == 1:
        return 1
    return 2 if (lines - opened) % 2 else 3


def _pieces_schema(conv: T.DataType) -> T.StructType:
    number, text = T.LongType(), T.StringType()
    step = [("p", T.IntegerType()), ("q", T.IntegerType()), ("cost", number), ("audit", text)]
    kinds = {"absent": T.BooleanType(), "conv": conv}
    kinds |= dict.fromkeys(("place", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), number)
    kinds |= dict.fromkeys(("audit", "repaired_sha256"), text)
    kinds |= {"n_rows": number, "first_role": text, "last_role": text}
    kinds |= dict.fromkeys(("turns", "first_turn", "last_turn"), number)
    kinds["entries"] = T.ArrayType(T.StructType([T.StructField(*pair) for pair in step]))
    kinds |= dict.fromkeys(("roles", "texts"), T.ArrayType(text))
    return T.StructType([T.StructField(*pair) for pair in kinds.items()])


class Settler:
    """Costs, audits and matrices of sequences, by one grammar for all of them."""

    def __init__(self) -> None:
        self.grammar = transfer.Grammar()
        self.known: dict[bytes, tuple[int, str]] = {}

    def repairs(self, sequences: list[bytes]) -> dict[bytes, tuple[int, str]]:
        fresh = sorted({s for s in sequences if s not in self.known})
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, fresh = {}, sorted(set(sequences))
        for s, compressed in zip(fresh, self.grammar.compress(fresh), strict=True):
            self.known[s] = self.grammar.repair(compressed)
        return self.known

    def entries(self, sequence: bytes) -> list[dict]:
        return transfer.packed(self.grammar.matrix(self.grammar.compress([sequence])[0]))


def settle(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Sorted rows to results of conversations (`place` is null) and to pieces of the others."""
    schema = _pieces_schema(rows.schema["conv"].dataType)

    def run(batches):
        settler, waiting = Settler(), []
        number = TaskContext.get().partitionId() << 32

        def whole() -> Iterator[dict]:
            repairs = settler.repairs([bytes(p.symbols) for _, p in waiting])
            for key, piece in waiting:
                cost, audit = repairs[bytes(piece.symbols)]
                lines = repaired_lines(piece.roles, piece.texts, audit, 0)
                yield {
                    **_facts(key, piece),
                    "gaps": gaps_of(piece.turns, piece.first_turn, piece.last_turn),
                    "cost": cost,
                    "audit": audit,
                    "repaired_sha256": hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest(),
                }
            waiting.clear()

        def part(key, piece) -> dict:
            nonlocal number
            number += 1
            return {
                **_facts(key, piece),
                "place": number,
                "n_rows": len(piece.roles),
                "first_role": piece.roles[0] if piece.roles else None,
                "last_role": piece.roles[-1] if piece.roles else None,
                "turns": piece.turns,
                "first_turn": piece.first_turn,
                "last_turn": piece.last_turn,
                "entries": settler.entries(bytes(piece.symbols)),
                "roles": piece.roles,
                "texts": piece.texts,
            }

        def found() -> Iterator[dict]:
            key, piece, cut, chars = None, Piece(), True, 0
            for batch in batches:
                columns = [batch.column(c) for c in (*GROUP, "timeless", "at", "role", "text", "copies", "repeat")]
                for at in range(batch.num_rows):
                    absent, conv, timeless, turn, role, text, copies, repeat = (c[at].as_py() for c in columns)
                    if (absent, conv) != key:
                        if key is not None:
                            if cut:
                                yield part(key, piece)
                            else:
                                waiting.append((key, piece))
                                chars += piece.chars
                            cut = False
                        key, piece = (absent, conv), Piece()
                        if len(waiting) >= TOGETHER or chars >= PIECE_CHARS:
                            yield from whole()
                            chars = 0
                    for copy in range(copies):
                        if len(piece.roles) >= piece_rows or piece.chars >= PIECE_CHARS:
                            yield part(key, piece)
                            piece, cut = Piece(), True
                        piece.met(None if timeless else turn)
                        piece.add(role, text, repeat or copy > 0)
            yield from whole()
            if key is not None:
                yield part(key, piece)

        arrow = _arrow(schema)
        held, size = [], 0
        for row in found():
            held.append(row)
            size += 1 + sum(map(len, row.get("roles", ()))) + sum(len(t or "") for t in row.get("texts", ()))
            if len(held) >= 1024 or size >= PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return rows.mapInArrow(tidy(run), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _facts(key: tuple, piece: Piece) -> dict:
    return {
        "absent": key[0],
        "conv": key[1],
        "blank": piece.blank,
        "duplicate": piece.duplicate,
        "truncated": piece.truncated,
        "illegal": piece.illegal,
    }


def gaps_of(turns: int, first: int | None, last: int | None) -> int:
    """Turns are sorted, so the first is the least and the last the greatest."""
    return 0 if first is None else last - first + 1 - turns


def merged(parts: list[dict]) -> dict:
    """The facts and the matrix of pieces that follow each other."""
    total = {name: sum(p[name] for p in parts) for name in ("blank", "duplicate", "truncated", "illegal", "n_rows", "turns")}
    last_role = last_turn = None
    filled = [p for p in parts if p["n_rows"]]
    for p in filled:
        if last_role is not None and last_role[:1] + p["first_role"][:1] not in LEGAL:
            total["illegal"] += 1
        last_role = p["last_role"]
        if p["first_turn"] is not None:
            if last_turn is not None and p["first_turn"] == last_turn:
                total["turns"] -= 1
            last_turn = p["last_turn"]
    total["first_role"] = filled[0]["first_role"] if filled else None
    total["last_role"] = last_role
    total["first_turn"] = next((p["first_turn"] for p in filled if p["first_turn"] is not None), None)
    total["last_turn"] = last_turn
    total["matrix"] = transfer.product_of([transfer.unpacked(p["entries"]) for p in parts])
    return total


MERGED = ["rank", "blank", "duplicate", "truncated", "illegal", "n_rows", "first_role", "last_role", "turns"]
MERGED += ["first_turn", "last_turn", "entries"]


def joined_up(pieces: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per conversation in pieces: its facts, cost and audit.

    Matrices are multiplied in rounds, `fan` neighbours at a time.
    """
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy("place")) - 1
    ranks = pieces.select(*GROUP, "place").withColumn("rank", rank.cast("long"))
    left = staged(pieces.join(ranks, [*GROUP, "place"]).select(*GROUP, *MERGED), "pieces-in-order")
    most = (left.agg(F.max("rank")).first()[0] or 0) + 1
    schema = left.schema

    def some(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["rank"])
        total = merged(rows)
        total["entries"] = transfer.packed(total.pop("matrix"))
        first = rows[0]
        row = {"absent": first["absent"], "conv": first["conv"], "rank": first["rank"] // fan, **total}
        return pa.Table.from_pylist([row], _arrow(schema))

    while most > fan:
        groups = left.groupBy(*GROUP, F.floor(F.col("rank") / fan))
        left = staged(groups.applyInArrow(some, schema), "pieces-multiplied")
        most = -(-most // fan)

    kept = [*GROUP, *[name for name in RESULT if name != "repaired_sha256"]]
    final = T.StructType([f for f in _pieces_schema(schema["conv"].dataType).fields if f.name in kept])

    def all_(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["rank"])
        total = merged(rows)
        cost, audit = transfer.ended(total["matrix"][0])
        row = {name: total[name] for name in ("blank", "duplicate", "truncated", "illegal")}
        row |= {"absent": rows[0]["absent"], "conv": rows[0]["conv"], "cost": cost, "audit": audit}
        row["gaps"] = gaps_of(total["turns"], total["first_turn"], total["last_turn"])
        return pa.Table.from_pylist([row], _arrow(final))

    return staged(left.groupBy(*GROUP).applyInArrow(all_, final), "joined-up")


def audits_of_pieces(pieces: DataFrame, whole: DataFrame) -> DataFrame:
    """Per piece its share of the conversation's audit, and the state it begins in."""
    fields = [f for f in pieces.schema.fields if f.name in (*GROUP, "place")]
    schema = T.StructType(fields + [T.StructField("share", T.StringType()), T.StructField("state", T.IntegerType())])

    def cut(part: pa.Table, audits: pa.Table) -> pa.Table:
        audit, rows = audits["audit"][0].as_py(), []
        pieces = sorted(part.to_pylist(), key=lambda r: r["place"])
        opened = (len(audit) - audit.count("D")) % 2 == 1  # pairs of lines may follow one other
        begin = lines = 0
        for i, piece in enumerate(pieces):
            end, left = begin, piece["n_rows"]
            if i == len(pieces) - 1:
                end = len(audit)
            while left and i < len(pieces) - 1:
                left -= audit[end] != "I"
                end += 1
            share = audit[begin:end]
            rows.append({**{f.name: piece[f.name] for f in fields}, "share": share, "state": state_behind(lines, opened)})
            lines += len(share) - share.count("D")
            begin = end
        return pa.Table.from_pylist(rows, _arrow(schema))

    audits = whole.select(*GROUP, "audit").groupBy(*GROUP)
    return pieces.select(*GROUP, "place", "n_rows").groupBy(*GROUP).cogroup(audits).applyInArrow(cut, schema)


def hashes(pieces: DataFrame, shares: DataFrame) -> DataFrame:
    """SHA-256 of the repaired lines of each conversation in pieces.

    Pieces write their lines first, each in a task of its own; the hash then streams them.
    """
    fields = [f for f in pieces.schema.fields if f.name in (*GROUP, "place")]
    written = T.StructType(fields + [T.StructField("lines", T.StringType())])

    def write(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                lines = repaired_lines(row["roles"], row["texts"], row["share"], row["state"])
                out = {f.name: row[f.name] for f in fields}
                out["lines"] = "\n".join(lines) if lines else None
                yield pa.RecordBatch.from_pylist([out], _arrow(written))

    texts = pieces.select(*GROUP, "place", "roles", "texts").join(shares, [*GROUP, "place"])
    lines = staged(texts.mapInArrow(tidy(write), written), "repaired-lines")
    hashed = T.StructType(fields[:2] + [T.StructField("repaired_sha256", T.StringType())])

    def digest(batches):
        key = state = None
        begun = False

        def row():
            values = {fields[0].name: key[0], fields[1].name: key[1], "repaired_sha256": state.hexdigest()}
            return pa.RecordBatch.from_pylist([values], _arrow(hashed))

        for batch in batches:
            for at in range(batch.num_rows):
                own = (batch["absent"][at].as_py(), batch["conv"][at].as_py())
                if own != key:
                    if key is not None:
                        yield row()
                    key, state, begun = own, hashlib.sha256(), False
                text = batch["lines"][at].as_py()
                if text is not None:
                    state.update((("\n" if begun else "") + text).encode("utf-8", "surrogatepass"))
                    begun = True
        if key is not None:
            yield row()

    return lines.repartition(*GROUP).sortWithinPartitions(*GROUP, "place").mapInArrow(tidy(digest), hashed)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_conversations(rows: DataFrame, piece_rows: int = PIECE_ROWS, fan: int = FAN) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its repair, the repaired
    rows as a hash. `piece_rows` and `fan` bound tasks and change no result."""
    own = rows.select("conv_id", "turn", "role", "text")
    marked = with_repeats(staged(counted(damaged(own)), "damaged-rows"))
    ordered = marked.repartitionByRange(*in_order()).sortWithinPartitions(*in_order())
    parts = staged(settle(ordered.drop("hash"), piece_rows), "conversations")
    pieces = parts.filter("place is not null")
    whole = joined_up(pieces, fan)
    rest = whole.join(hashes(pieces, audits_of_pieces(pieces, whole)), GROUP)
    found = parts.filter("place is null").select(*GROUP, *RESULT).unionByName(rest.select(*GROUP, *RESULT))
    return found.select(F.when(~F.col("absent"), F.col("conv")).alias("conv_id"), *RESULT)
