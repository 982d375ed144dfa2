"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is lines of text.  Hidden states are whether the transcript marks its speakers, a role,
and 'opens a turn' or 'goes on'; a line shows a speaker marker (of some role, of an unknown speaker, or
none), whether a blank line precedes it, its length, and whether it asks.  Viterbi's path gives the
turns, rendered as <|role|>, the text, and <|end|>.  No word is lost: a marker goes only from a line
that opens a turn of its role, and blank lines within a turn stay.

Transition and emission tables are counted, with smoothing, over all conversations but a held-out
fifth (by a hash of conv_id), written out in each style of STYLES, with and without paragraphs.

A conversation may be of any length.  Its rows are sorted by range and cut into blocks of bounded
size; each block's best scores between any two states make a matrix, the products of which
(BRANCH at a time, level by level) give the states at all block ends, so blocks are decoded apart and
the path is that of the whole conversation.  A conversation's blocks, joined in order, are its rendering.

Defined cases: a null or blank text is no turn, and a conversation without any has no row; an
unknown or null role is rendered as user; rows without conv_id form a conversation, held out; rows
without turn come last in theirs; repeated rows count once; '<|' within a text becomes '<\\|'; without
training turns the tables are uniform but for the markers; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, temporary, written

ROLES = ("system", "user", "assistant")
#: A block has so many turns, or bytes of text, at most (a longer turn is a block of its own).
BLOCK, BLOCK_BYTES = 64, 1 << 20
#: Blocks, or products of blocks, that are multiplied in one step.
BRANCH = 256
FOLDS = 5
#: Words by which transcripts call each role.
SPEAKERS = {
    "system": ("system", "instructions", "instruction", "context"),
    "user": ("user", "human", "customer", "question", "q", "you", "prompter"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a", "gpt"),
}
ROLE_OF = {w: i for i, r in enumerate(ROLES) for w in SPEAKERS[r]}
#: A marker: a known speaker's name, dressed, before a colon; or dressed and alone on its line.
MARKER = re.compile(r"^\s*(?:[#>*\[<|(]+\s*)?([A-Za-z]{1,12})\s*(?:[\]>|)*]*\s*:[\]>|)*]*\s*|[\]>|)*]+\s*|(?<=[A-Za-z])\s*$)")
#: How the training and query transcripts write a turn; the last one marks no speakers.
STYLES = ("named", "headed", "bracketed", "spaced")
NAMES = (("System", "User", "Assistant"), ("### System", "### Human", "### Assistant"), ("[system]", "[user]", "[assistant]"))
KINDS = 5  # no marker, one of the roles, another speaker


def body_lines(text: str) -> list[str]:
    """A turn's lines, without blank ones at either end."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    return lines[full[0] : full[-1] + 1] if full else []


def written_turn(style: int, role: int, lines: list[str]) -> list[str]:
    name = STYLES[style]
    if name == "headed":
        return [NAMES[1][role], *lines]
    if name == "spaced":
        return list(lines)
    mark = f"{NAMES[0][role]}: " if name == "named" else f"{NAMES[2][role]} "
    return [mark + lines[0], *lines[1:]]


def marker(line: str) -> tuple[int, int]:
    """Marker kind (0 none, 1.. the role, 4 another speaker) and the length of a role's marker."""
    found = MARKER.match(line)
    if not found:
        return 0, 0
    role = ROLE_OF.get(found[1].lower())
    if role is None:
        return (4, 0) if found[0].rstrip().endswith(":") else (0, 0)
    if found[0].strip().isalpha():
        return 0, 0
    return 1 + role, found.end()


@dataclass
class Line:
    text: str
    cut: int  # length of its marker
    blanks: int  # blank lines before it
    shown: tuple[int, int, int, int]  # marker kind, whether blank lines precede, length bin, asks


def read_lines(raw: Sequence[str], blanks: int) -> list[Line]:
    """Lines that aren't blank; `blanks` stand before the first."""
    out = []
    for text in raw:
        if not text.strip():
            blanks += 1
            continue
        kind, cut = marker(text)
        length = min((len(text) - cut + 1).bit_length() - 1, 11)
        out.append(Line(text, cut, blanks, (kind, int(blanks > 0), length, int(text.rstrip().endswith("?")))))
        blanks = 0
    return out


def turn_lines(style: int, role: int, lines: list[str], first: bool) -> list[Line]:
    """A turn as a transcript of the style has it: a blank line stands before an unmarked one."""
    return read_lines(written_turn(style, role, lines), int(first or STYLES[style] == "spaced"))


SHAPES = (KINDS, 2, 12, 2)
STATES = 4 * len(ROLES)  # unmarked * 6 + role * 2 + goes on; STATES itself is before the start
NEVER = -(1 << 40)
SIZES = [STATES, STATES * STATES, *(STATES * n for n in SHAPES)]


def counts_of(styles: Sequence[tuple[int, bool]], role: int, lines: list[str], first: bool, last: int) -> list[int]:
    """Places in the flat count tables that one turn adds to; last: role * 2 + (several lines) of the
    turn before, -1 without one."""
    out = []
    ends = np.cumsum([0, *SIZES])
    for style, paragraphs in styles:
        unmarked = 6 * int(STYLES[style] == "spaced")
        own = lines
        if paragraphs:
            own = [y for x in lines for y in (x, "")][:-1] if len(lines) > 1 else lines[0].replace(". ", ".\n\n", 1).split("\n")
        before = STATES if last < 0 else unmarked + (last | int(STYLES[style] == "headed"))
        for i, line in enumerate(turn_lines(style, role, own, first)):
            state = unmarked + 2 * role + int(i > 0)
            out.append(state if before == STATES else int(ends[1]) + before * STATES + state)
            out += [int(ends[2 + k]) + state * SHAPES[k] + x for k, x in enumerate(line.shown)]
            before = state
    return out


VARIANTS = [(0, False), (0, True), (1, False), (1, True), (2, False), (2, True), (3, False), (3, False), (3, False)]


@dataclass
class Tables:
    """Scaled logarithms: move (from each state or the start, to each state) and show (each feature).
    They are whole numbers, so sums don't depend on the order in which they are taken."""

    move: np.ndarray
    show: list[np.ndarray]

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Tables:
        start, move, *show = np.split(counts.astype(np.float64), np.cumsum(SIZES)[:-1])
        start, move = start.copy(), move.reshape(STATES, STATES).copy()
        show = [t.reshape(STATES, -1) + 0.5 for t in show]
        on, role, mode = (np.arange(STATES) % 2 == 1), np.arange(STATES) % 6 // 2, np.arange(STATES) // 6
        start += np.where(on, 0, 1)
        move += 0.5
        for i, r in enumerate(ROLES):
            for state in np.flatnonzero((role == i) & (mode == 0)):
                show[0][state, 0 if on[state] else 1 + i] += 20  # a role's marker opens its turns
            for state in np.flatnonzero((role == i) & (mode == 1)):
                show[0][state, 0] += 20
        # only the same role goes on, and a transcript keeps to its way
        never = (mode[:, None] != mode[None]) | (on[None] & (role[:, None] != role[None]))
        move[never] = 0

        def logs(t):
            with np.errstate(divide="ignore"):
                return np.where(t > 0, np.round(np.log(t / t.sum(axis=1, keepdims=True)) * 65536), NEVER).astype(np.int64)

        return cls(logs(np.concatenate([move, start[None]])), [logs(t) for t in show])

    def seen(self, lines: Sequence[Line]) -> np.ndarray:
        return sum(t[:, [x.shown[k] for x in lines]] for k, t in enumerate(self.show))

    def matrix(self, lines: Sequence[Line]) -> np.ndarray:
        """Best score of the lines from each state before them to each state of the last."""
        seen = self.seen(lines)
        best = self.move + seen[:, 0]
        for i in range(1, len(lines)):
            best = (best[:, :, None] + self.move[None, :STATES]).max(axis=1) + seen[:, i]
        return np.maximum(best, NEVER)

    def path(self, lines: Sequence[Line], enter: int = STATES, leave: int | None = None) -> list[int]:
        """The likeliest states between two given ones; of equal ones the first."""
        seen = self.seen(lines)
        best = self.move[enter] + seen[:, 0]
        back = []
        for i in range(1, len(lines)):
            paths = best[:, None] + self.move[:STATES]
            came = paths.argmax(axis=0)
            back.append(came)
            best = paths[came, np.arange(STATES)] + seen[:, i]
        state = int(best.argmax()) if leave is None else leave
        out = [state]
        for came in reversed(back):
            state = int(came[state])
            out.append(state)
        return out[::-1]


def product(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Best scores through two stretches one after the other."""
    return np.maximum((one[:, :, None] + two[None, :STATES]).max(axis=1), NEVER)


def ends_between(matrices: Sequence[np.ndarray], enter: int, leave: int) -> list[int]:
    """The states at the ends of the stretches on the best path from enter to leave."""
    ways = [matrices[0][enter]]
    for m in matrices[1:]:
        ways.append((ways[-1][:, None] + m[:STATES]).max(axis=0))
    out = [leave]
    for way, m in zip(reversed(ways[:-1]), reversed(matrices[1:])):
        out.append(int((way + m[:STATES, out[-1]]).argmax()))
    return out[::-1]


def _escape(text: str) -> str:
    return text.replace("<|", "<\\|")


END = "\n<|end|>\n"


def rendered(states: Sequence[int], lines: Sequence[Line], first: bool = True, last: bool = True) -> str:
    """The turns of a stretch of a transcript; a turn is closed by what follows it."""
    out, begun = [], not first
    for state, line in zip(states, lines):
        opens, role = state % 2 == 0, state % 6 // 2
        text = line.text
        if opens:
            out.append((END if begun else "") + f"<|{ROLES[role]}|>")
            if line.shown[0] == 1 + role:
                text = text[line.cut :]
        if text or not opens:
            out.append("\n" * (1 + (0 if opens else line.blanks)) + _escape(text))
        begun = True
    return "".join(out) + (END if last and begun else "")


def parse(tables: Tables, transcript: str) -> str:
    """A raw transcript's canonical turns."""
    lines = read_lines(transcript.split("\n"), 1)
    return rendered(tables.path(lines), lines) if lines else ""


def _role(name) -> int:
    return ROLES.index(name) if name in ROLES else 1


BLOCKS = "pid int, seq int, conv_id long, slice int, head boolean, last_role int, roles array<int>, texts array<string>"


def _blocks(most: int, most_bytes: int):
    """Rows conv_id, turn, role, text in order -> blocks of consecutive turns of one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, number, head, size = TaskContext.get().partitionId(), 0, 0, True, 0
        conv, last, roles, texts, begun = None, -1, [], [], False
        told = -1  # the turn before the block

        def block():
            return pa.record_batch(
                [
                    pa.array([pid], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([conv], pa.int64()),
                    pa.array([number], pa.int32()),
                    pa.array([head]),
                    pa.array([told], pa.int32()),
                    pa.array([roles], pa.list_(pa.int32())),
                    pa.array([texts], pa.list_(pa.string())),
                ],
                names=["pid", "seq", "conv_id", "slice", "head", "last_role", "roles", "texts"],
            )

        for batch in batches:
            for own, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                lines = body_lines(text or "")
                if not lines:
                    continue
                other = not begun or own != conv
                if roles and (other or len(roles) >= most or size + len(text) > most_bytes):
                    yield block()
                    seq, number, roles, texts, size = seq + 1, number + 1, [], [], 0
                    told = last
                if other:
                    head = not begun
                    conv, number, told, begun = own, 0, -1, True
                roles.append(_role(role))
                texts.append(text)
                size += len(text)
                last = 2 * roles[-1] + int(sum(bool(x.strip()) for x in lines) > 1)
        if roles:
            yield block()

    return run


def blocks(conversations: DataFrame, most: int = BLOCK, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, block (0.. in its conversation), last_role, roles, texts, over a written table.

    Rows are dealt out by range of (conversation, turn, role, text), so one conversation may lie in
    several tasks; only what each task has at its ends comes to the driver, a row for each task."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    ).distinct()
    keys = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last()]
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *keys, "h").sortWithinPartitions(*keys, "h", "text")
    found = written(ordered.select("conv_id", "turn", "role", "text").mapInArrow(_blocks(most, most_bytes), BLOCKS), "chat-blocks")
    multi = F.size(F.filter(F.split(F.element_at("texts", -1), "\n"), lambda x: F.trim(x) != "")) > 1
    at = F.struct("conv_id", "slice", "head", (2 * F.element_at("roles", -1) + multi.cast("int")).alias("last"))
    tasks = found.groupBy("pid").agg(F.min_by("conv_id", "seq").alias("first"), F.max_by(at, "seq").alias("end")).orderBy("pid").collect()
    heads, end = [], None  # for each task: blocks and last turn of its first conversation in the tasks before
    for task in tasks:
        goes_on = end is not None and end[0] == task["first"]
        offset, last = (end[1], end[2]) if goes_on else (0, -1)
        heads.append((task["pid"], offset, last))
        own = task["end"]
        end = (own["conv_id"], own["slice"] + 1 + (offset if own["head"] else 0), own["last"])
    heads = spark.createDataFrame(heads, "pid int, offset int, before int")
    placed = found.join(F.broadcast(heads), "pid")  # a row for each task
    return placed.select(
        "conv_id",
        (F.col("slice") + F.when(F.col("head"), F.col("offset")).otherwise(0)).alias("block"),
        F.when(F.col("head") & (F.col("slice") == 0), F.col("before")).otherwise(F.col("last_role")).alias("last_role"),
        "roles",
        "texts",
    )


def held_out(conv_id):
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(sum(SIZES), np.int64)
    for batch in batches:
        for number, last, roles, texts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for k, (role, text) in enumerate(zip(roles, texts)):
                lines = body_lines(text)
                np.add.at(counts, counts_of(VARIANTS, role, lines, number == 0 and k == 0, last), 1)
                last = 2 * role + int(sum(bool(x.strip()) for x in lines) > 1)
    yield pa.record_batch([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], names=["at", "n"])


def train(parts: DataFrame) -> Tables:
    """Tables counted over all blocks of conversations that aren't held out."""
    rows = parts.where(~held_out(F.col("conv_id"))).select("block", "last_role", "roles", "texts")
    found = rows.mapInArrow(_counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # SIZES rows at most
    counts = np.zeros(sum(SIZES), np.int64)
    for r in found:
        counts[r["at"]] = r["n"]
    return Tables.from_counts(counts)


def style_of(conv) -> int:
    return int.from_bytes(hashlib.sha256(str(conv).encode()).digest()[:4], "big") % len(STYLES)


def _lines_of(conv, number: int, roles, texts) -> list[list[Line]]:
    """The lines of each turn of a block."""
    style = style_of(conv)
    return [turn_lines(style, r, body_lines(t), number == 0 and k == 0) for k, (r, t) in enumerate(zip(roles, texts))]


def _matrices(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, number, roles, texts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines = [x for own in _lines_of(conv, number, roles, texts) for x in own]
                out.append((conv, number, tables.matrix(lines).tobytes()))
            yield _nodes(out)

    return run


NODES = "conv_id long, at long, m binary"


def _nodes(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "at", "m"])


def _matrix(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(STATES + 1, STATES)


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, at, children in zip(*(batch.column(i).to_pylist() for i in range(3))):
            whole = _matrix(children[0]["m"])
            for child in children[1:]:
                whole = product(whole, _matrix(child["m"]))
            out.append((conv, at, whole.tobytes()))
        yield _nodes(out)


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, children, enter, leave -> each child's enter and leave."""
    for batch in batches:
        out = []
        for conv, children, enter, leave in zip(*(batch.column(i).to_pylist() for i in range(4))):
            matrices = [_matrix(x["m"]) for x in children]
            if leave is None:  # a whole conversation
                whole = matrices[0][enter]
                for m in matrices[1:]:
                    whole = (whole[:, None] + m[:STATES]).max(axis=0)
                leave = int(whole.argmax())
            for child, end in zip(children, ends_between(matrices, enter, leave)):
                out.append((conv, child["at"], enter, end))
                enter = end
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["conv_id", "at", "enter", "leave"])


def block_ends(nodes: DataFrame, branch: int = BRANCH) -> DataFrame:
    """conv_id, at, enter, leave: the states between which each block's path lies.

    nodes(conv_id, at, m).  Up: products of `branch` neighbours until one is left for each conversation;
    down: the ends of a product's factors."""
    levels, now = [], nodes
    while True:
        grouped = now.groupBy("conv_id", F.floor(F.col("at") / branch).alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("at", "m"))).alias("children")  # `branch` at most
        )
        levels.append(written(grouped, "chat-level"))
        if not (levels[-1].agg(F.max("up")).first()[0] or 0):
            break
        products = levels[-1].select("conv_id", F.col("up").alias("at"), "children").mapInArrow(_multiplied, NODES)
        now = written(products, "chat-products")
    shape = "conv_id long, at long, enter int, leave int"
    top = levels[-1].select("conv_id", "children", F.lit(STATES).alias("enter"), F.lit(None).cast("int").alias("leave"))
    ends = top.mapInArrow(_divided, shape)
    for level in reversed(levels[:-1]):
        up = ends.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), "enter", "leave")
        joined = level.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("a")))
        ends = joined.select("conv_id", "children", "enter", "leave").mapInArrow(_divided, shape)
    return ends


OUT = "conv_id long, block long, style string, n_turns long, n_parsed long, n_right long, rendered string"


def _decoded(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, number, roles, texts, enter, leave, last in zip(*(batch.column(i).to_pylist() for i in range(7))):
                own = _lines_of(conv, number, roles, texts)
                lines = [x for turn in own for x in turn]
                states = tables.path(lines, STATES if enter is None else enter, leave)
                right, at = 0, 0
                for role, turn in zip(roles, own):
                    got = states[at : at + len(turn)]
                    right += got[0] % 6 == 2 * role and all(x % 2 for x in got[1:])
                    at += len(turn)
                text = rendered(states, lines, number == 0, last)
                out.append((conv, number, STYLES[style_of(conv)], len(roles), sum(x % 2 == 0 for x in states), int(right), text))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = ["conv_id", "block", "style", "n_turns", "n_parsed", "n_right", "rendered"]
            yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def recover(conversations: DataFrame, most: int = BLOCK, most_bytes: int = BLOCK_BYTES, branch: int = BRANCH) -> DataFrame:
    """Write each conversation as a raw transcript, parse it, render it: conv_id, block, style, n_turns
    (as written), n_parsed (as opened), n_right (turns recovered whole with their role), rendered, held_out."""
    parts = blocks(conversations, most, most_bytes)
    tables = train(parts)
    several = parts.where("block > 0").groupBy("conv_id").agg(F.max("block").alias("final"))
    several = written(several.withColumnRenamed("conv_id", "c"), "chat-several")
    if several.isEmpty():
        rows = parts.withColumns({"enter": F.lit(None).cast("int"), "leave": F.lit(None).cast("int"), "last": F.lit(True)})
    else:
        long = parts.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "block", "roles", "texts")
        with temporary(conversations.sparkSession):
            nodes = written(long.mapInArrow(_matrices(tables), NODES), "chat-nodes")
            ends = written(block_ends(nodes, branch), "chat-ends", keep=True)
        ends = ends.toDF("e", "at", "enter", "leave").join(several, F.col("e").eqNullSafe(F.col("c")))
        rows = parts.join(ends, F.col("conv_id").eqNullSafe(F.col("e")) & (F.col("block") == F.col("at")), "left")
        rows = rows.withColumn("last", F.coalesce(F.col("block") == F.col("final"), F.lit(True)))
    done = rows.select("conv_id", F.col("block").cast("long"), "roles", "texts", "enter", "leave", "last").mapInArrow(_decoded(tables), OUT)
    return done.withColumn("held_out", held_out(F.col("conv_id")))


def _format(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [parse(tables, x or "") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "rendered"])

    return run


def format_transcripts(raw: DataFrame, tables: Tables, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, rendered of raw transcripts, with tables from `train`."""
    rows = raw.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_format(tables), "id long, rendered string")
