"""Transcript parsing by a hidden Markov model, and canonical rendering of turns.

A transcript is plain text in which speakers are marked in one of many ways, or not at all. Each line
is observed by its speaker marker and a few features; the hidden states are a role that begins or
goes on. The model's probabilities are counted over all labelled transcripts, outside a held-out fold, and added to
built-in ones of little weight. Viterbi finds the likeliest sequence of states for all lines together, so that an
unmarked line gets its role from its neighbours, and a "Note:" within an answer stays in it. Turns are then
rendered in one canonical form.

A conversation of any length is parsed as a whole: it is written in parts of a bounded number of turns, each part tells the
best score from every state before it to every state at its end, a fold over these small tables settles the states at the
parts' borders, and each part is decoded between its borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialise, pick, table

ROLES = ("system", "user", "assistant")
#: Names that mark a speaker.
NAMES = {
    "system": ["system", "sys", "instructions", "context"],
    "user": ["user", "human", "question", "q", "prompt", "customer", "instruction", "me", "prompter", "student"],
    "assistant": ["assistant", "ai", "bot", "answer", "a", "response", "model", "agent", "gpt", "chatbot", "teacher"],
}
BY_NAME = {n: r for r, names in NAMES.items() for n in names}
#: "Name: text", "### Name", "[Name]", "**Name:**", "<|name|>", "<|im_start|>name", "> Name -"
MARKER = re.compile(r"\s*(?:<\|im_start\|>\s*(?P<c>\w+)\s*$|<\|(?P<t>\w+)\|>\s*|#{1,6}\s*(?P<h>[\w ]{1,20}?)\s*:?\s*$|\[(?P<b>[\w ]{1,20})\]\s*:?\s*|\*\*(?P<s>[\w ]{1,20}?)\s*:?\*\*\s*:?\s*|(?P<n>[A-Za-z][\w ]{0,19}?)\s*(?:\(\d\d?:\d\d\))?\s*[:>]\s+)")
ENDS = re.compile(r"<\|(?:im_end|end|eot_id|endoftext)\|>\s*$")
#: What a line shows first: a marker of a role, some other name, nothing at all, or no marker.
SEEN = ("system", "user", "assistant", "name", "blank", "none")
LOW = 1e-6


def observe(line: str) -> tuple[int, int, str]:
    """``(what is seen, features, text without its marker)`` of a line.

    Features: bit 0 a question, bit 1 long (over 300 characters), bit 2 list or code.
    """
    body = ENDS.sub("", line)
    if not body.strip():
        return SEEN.index("blank"), 0, ""
    seen = "none"
    m = MARKER.match(body)
    if m:
        name = next(v for v in m.groupdict().values() if v is not None).strip().lower()
        role = BY_NAME.get(name)
        if role:
            seen, body = role, body[m.end() :]
        else:
            seen = "name"
    text = body.strip()
    f = (text.endswith("?")) | (len(text) > 300) << 1 | bool(re.match(r"[-*\d`|{}]", text)) << 2
    return SEEN.index(seen), int(f), body


#: A part's border: no state before the first part, and none fixed at the end.
OPEN = -1


class RoleModel:
    """States 2 * role (a turn begins) and 2 * role + 1 (it goes on), with log-probabilities."""

    def __init__(self, begin_marked: float = 0.9, dropped: float = 0.08):
        """Built-in values, to which ``fit`` adds counts."""
        n = len(ROLES)
        # A turn of a role: who speaks next. Users and assistants mostly alternate.
        follow = np.array([[0.02, 0.93, 0.05], [0.01, 0.04, 0.95], [0.01, 0.95, 0.04]])
        stay = np.array([0.3, 0.35, 0.6])
        self.start = np.full(2 * n, LOW)
        self.start[[0, 2, 4]] = [0.15, 0.8, 0.05]
        self.move = np.full((2 * n, 2 * n), LOW)
        for r in range(n):
            for at in (2 * r, 2 * r + 1):
                self.move[at, 2 * r + 1] = stay[r]
                self.move[at, 0::2] = (1 - stay[r]) * follow[r]
        self.seen = np.full((2 * n, len(SEEN)), LOW)
        for r in range(n):
            self.seen[2 * r, r] = begin_marked
            self.seen[2 * r, [SEEN.index("none"), SEEN.index("name")]] = [dropped, 0.01]
            self.seen[2 * r + 1, [SEEN.index("none"), SEEN.index("blank"), SEEN.index("name")]] = [0.7, 0.22, 0.06]
            self.seen[2 * r + 1, :n] = 0.0005
        # Question, long, list: users ask, assistants explain at length.
        p = np.array([[0.02, 0.1, 0.1], [0.3, 0.1, 0.05], [0.08, 0.45, 0.15]])
        bits = (np.arange(8)[:, None] >> np.arange(3)) & 1
        self.shape = np.stack([np.prod(np.where(bits, q, 1 - q), axis=1) for q in np.repeat(p, 2, axis=0)])
        self._logs()

    def _logs(self) -> None:
        self.log = tuple(np.log(x / x.sum(axis=-1, keepdims=True)) for x in (self.start, self.move, self.seen, self.shape))

    def tables(self) -> dict[str, np.ndarray]:
        return {"start": self.start, "move": self.move, "seen": self.seen, "shape": self.shape}

    def fit(self, counts: dict[str, np.ndarray], weight: float = 50.0) -> RoleModel:
        """``count_lines`` of labelled transcripts join the built-in values, which weigh as ``weight`` lines."""
        for name, table in self.tables().items():
            table[...] = table * weight / table.sum(axis=-1, keepdims=True) + counts.get(name, 0)
        self._logs()
        return self

    def emissions(self, observed: list[tuple[int, int]]) -> np.ndarray:
        _, _, seen, shape = self.log
        blank = SEEN.index("blank")
        return np.stack([seen[:, o] + (0 if o == blank else shape[:, f]) for o, f in observed])

    def viterbi(self, observed: list[tuple[int, int]], before: int = OPEN, last: int = OPEN) -> list[int]:
        """The likeliest states, after the state ``before`` and up to the state ``last`` where given; the first in order on a tie."""
        if not observed:
            return []
        emit = self.emissions(observed)
        start, move = self.log[:2]
        back = np.zeros(emit.shape, np.int8)
        now = (start if before == OPEN else move[before]) + emit[0]
        for i in range(1, len(observed)):
            reach = now[:, None] + move
            back[i] = reach.argmax(axis=0)
            now = reach.max(axis=0) + emit[i]
        out = [int(now.argmax()) if last == OPEN else last]
        for i in range(len(observed) - 1, 0, -1):
            out.append(int(back[i][out[-1]]))
        return out[::-1]

    def transfer(self, observed: list[tuple[int, int]]) -> np.ndarray:
        """The best score from each state before to each state at the end; in the last row from the start of a conversation."""
        emit = self.emissions(observed)
        start, move = self.log[:2]
        now = np.vstack([move, start]) + emit[0]
        for e in emit[1:]:
            now = (now[:, :, None] + move).max(axis=1) + e
        return now


LINES = re.compile(r"\r\n|\r|\n")


def read_lines(transcript: str | None) -> list[tuple[int, int, str]]:
    """What is observed of each line; a null or blank transcript has none."""
    return [observe(x) for x in LINES.split(transcript)] if transcript and transcript.strip() else []


def turns_of(states: list[int], lines: list[tuple[int, int, str]], role_before: int = OPEN) -> tuple[bool, list[tuple[str, str]]]:
    """Whether the first turn goes on from ``role_before``, and ``(role, text)`` of each. Blank lines around a turn are dropped, those
    within it stay, and so do none of a turn without text."""
    turns: list[tuple[int, list[str]]] = []
    continued = False
    for state, (_, _, body) in zip(states, lines, strict=True):
        if not turns:
            continued = state % 2 == 1 and state // 2 == role_before
        if state % 2 == 0 or not turns or turns[-1][0] != state // 2:
            turns.append((state // 2, []))
        turns[-1][1].append(body)
    out = [(ROLES[r], "\n".join(b).strip()) for r, b in turns]
    return continued and bool(out) and bool(out[0][1]), [t for t in out if t[1]]


def parse(transcript: str | None, model: RoleModel) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn."""
    lines = read_lines(transcript)
    return turns_of(model.viterbi([(o, f) for o, f, _ in lines]), lines)[1]


def render(turns: list[tuple[str, str]], continued: bool = False) -> str:
    """Canonical form: each turn in start and end tags; tags within a text are broken by a zero-width space. A turn that goes on from the
    part before has no start tag; its end is the part's to tell."""
    safe = lambda t: t.replace("<|", "<\u200b|")
    out = [f"<|{role}|>\n{safe(text)}\n<|end|>\n" for role, text in turns]
    if continued:
        out[0] = out[0].split("\n", 1)[1]
    return "".join(out)


def count_lines(transcript: str, shape: list[tuple[str, int]]) -> dict[str, np.ndarray]:
    """Counts for ``RoleModel.fit`` of a transcript whose turns' roles and numbers of lines are known; none where a role isn't."""
    out = {name: np.zeros_like(table) for name, table in RoleModel().tables().items()}
    if any(role not in ROLES for role, _ in shape):
        return out
    states = [2 * ROLES.index(role) + (i > 0) for role, n in shape for i in range(n)]
    before = OPEN
    for state, line in zip(states, LINES.split(transcript), strict=True):
        o, f, _ = observe(line)
        out["seen"][state, o] += 1
        if SEEN[o] != "blank":
            out["shape"][state, f] += 1
        if before == OPEN:
            out["start"][state] += 1
        else:
            out["move"][before, state] += 1
        before = state
    return out


#: Ways in which the query writes transcripts: how a role is named and put.
STYLES = [
    ({"system": "System", "user": "User", "assistant": "Assistant"}, "{}: "), ({"system": "Context", "user": "Human", "assistant": "AI"}, "{}: "),
    ({"system": "System", "user": "Instruction", "assistant": "Response"}, "### {}:\n"), ({"system": "Instructions", "user": "Q", "assistant": "A"}, "{}: "),
    ({"system": "system", "user": "user", "assistant": "assistant"}, "<|im_start|>{}\n"), ({"system": "System", "user": "Customer", "assistant": "Agent"}, "**{}:** "),
]


def write_transcript(turns: list[tuple[str | None, str | None]], style: int, drop: int) -> tuple[str, list[tuple[str, int]]]:
    """A transcript in a style, without the marker of each ``drop``-th turn (0: with all); and (role, lines) of its turns.

    A null text is an empty one. A turn without a role has no marker, and is more of the one before it; with none before, it is the user's.
    """
    names, form = STYLES[style % len(STYLES)]
    out, shape = [], []
    for i, (role, text) in enumerate(turns):
        mark = "" if role is None or (drop and i and i % drop == 0) else form.format(names.get(role, role))
        out.append(mark + (text or ""))
        n = len(LINES.split(out[-1]))
        if role is None and shape:
            shape[-1] = (shape[-1][0], shape[-1][1] + n)
        else:
            shape.append((role or "user", n))
    return "\n".join(out), shape


def truth_of(turns: list[tuple[str | None, str | None]]) -> list[tuple[str, str]]:
    """``(role, text)`` of the turns that a transcript of them should give."""
    out: list[tuple[str, str]] = []
    for role, text in turns:
        if role is None and out:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{text or ''}")
        else:
            out.append((role or "user", text or ""))
    return [(r, "\n".join(LINES.split(t)).strip()) for r, t in out if t.strip()]


def parts_of(rows: DataFrame, max_turns: int) -> DataFrame:
    """``rows(_id, turn, ..)`` with ``part``, a struct in whose order parts follow each other, of ``2 * max_turns`` rows each at most.

    Parts are ranges of turn numbers; one with more rows, as numbers repeat, is cut by number, and a number with more rows than that
    into pieces by a hash, as its rows have no order. Only such ranges, found by counts combined before the shuffle, are joined.
    """
    cell = F.floor(F.coalesce("turn", F.lit(-1)) / max_turns)
    placed = rows.withColumn("_cell", cell).withColumn("_k", F.struct("_id", "_cell")).withColumn("_row", F.monotonically_increasing_id())
    wide = placed.groupBy("_id", "_cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * max_turns)
    crowded = placed.alias("p").join(bounded(wide.select("_id", "_cell"), 32).alias("w"), F.col("p._id").eqNullSafe(F.col("w._id")) & (F.col("p._cell") == F.col("w._cell")), "left_semi")
    repeated = crowded.groupBy("_id", "_cell", "turn").agg(F.count(F.lit(1)).alias("n")).withColumn("pieces", F.when(F.col("n") > 2 * max_turns, F.ceil(F.col("n") / max_turns)).otherwise(1).cast("bigint"))
    cut = materialise(repeated.select(F.col("_id").alias("_i"), F.col("_cell").alias("_c"), F.col("turn").alias("_t"), "pieces"), "crowded-turns")
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_cell") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t"))
    met = placed.join(bounded(cut, 48), same, "left")
    at = F.when(F.col("pieces").isNotNull(), F.coalesce("turn", F.lit(-1)))
    part = F.struct(F.col("_cell").alias("cell"), at.cast("bigint").alias("turn"), F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("_row"), F.col("pieces"))).alias("piece"))
    return met.withColumn("part", part).drop("_cell", "_k", "_row", "_i", "_c", "_t", "pieces")


def transcripts(conversations: DataFrame, max_turns: int = 512, drop: int = 5, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(_id, part, transcript, roles, texts, lines)``: a conversation written as plain text, styled by a hash of its id.

    It is written in parts (see ``parts_of``), so a long one is no single row; ``part`` orders them. ``roles`` and ``texts`` are those of the
    turns that should be found, ``lines`` the roles and numbers of lines of the turns as written. Turns of one number come
    by role and text, rows that repeat are turns of their own, null numbers come first, and a null conversation is one by itself.
    For null roles and texts see ``write_transcript``. An empty table gives none; other columns are not read.
    """
    rows = pick(conversations, _id=conv_col, turn=turn_col, role=role_col, text=text_col).withColumn("turn", F.col("turn").cast("bigint"))
    grouped = parts_of(rows, max_turns).groupBy("_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    grouped = grouped.withColumn("style", F.pmod(F.xxhash64("_id"), F.lit(len(STYLES))))
    kinds = dict(grouped.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turns = [[(t["role"], t["text"]) for t in ts] for ts in b["turns"]]
            made = [write_transcript(t, int(s), drop) for t, s in zip(turns, b["style"], strict=True)]
            true = [truth_of(t) for t in turns]
            yield pd.DataFrame({
                "_id": b["_id"], "part": b["part"], "transcript": [m[0] for m in made], "roles": [[r for r, _ in t] for t in true], "texts": [[x for _, x in t] for t in true],
                "lines": [[{"role": r, "n": n} for r, n in m[1]] for m in made],
            })

    return grouped.mapInPandas(run, f"_id {kinds['_id']}, part {kinds['part']}, transcript string, roles array<string>, texts array<string>, lines array<struct<role:string,n:int>>")


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def fitted(written: DataFrame) -> RoleModel:
    """The model of all ``written(_id, transcript, lines)`` outside fold 2. Counts are added up where the lines are; a few dozen rows come to the driver."""
    shapes = {name: table.shape for name, table in RoleModel().tables().items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {name: np.zeros(shape) for name, shape in shapes.items()}
        for b in batches:
            for t, lines in zip(b["transcript"], b["lines"], strict=True):
                for name, c in count_lines(t, [(x["role"], x["n"]) for x in lines]).items():
                    total[name] += c
        yield pd.DataFrame([(name, i, n) for name, c in total.items() for i, n in enumerate(c.ravel()) if n], columns=["name", "i", "n"])

    counted = written.where(F.coalesce(fold(F.col("_id")) != 2, F.lit(True))).select("transcript", "lines").mapInPandas(run, "name string, i int, n double").groupBy("name", "i").agg(F.sum("n").alias("n"))
    counts = {name: np.zeros(shape) for name, shape in shapes.items()}
    for r in counted.collect():
        counts[r["name"]].ravel()[r["i"]] += r["n"]
    return RoleModel().fit(counts)


def borders(parts: DataFrame, model: RoleModel) -> DataFrame:
    """``(_id, part, before, last)``: the states at the borders of each of ``parts(_id, part, transcript)`` in the likeliest sequence of its conversation.

    Blank parts have no lines and are left out. Each part becomes one small table; these are folded in order, and then back from
    the end, in two sorted passes over one row a part.
    """
    kinds = dict(parts.dtypes)
    keys = f"_id {kinds['_id']}, part {kinds['part']}"
    n = 2 * len(ROLES)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = [read_lines(t) for t in b["transcript"]]
            out = b.loc[[bool(x) for x in lines], ["_id", "part"]].copy()
            out["score"] = [model.transfer([(o, f) for o, f, _ in x]).ravel() for x in lines if x]
            yield out

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, now = object(), None
        for b in batches:
            froms, ends = [], []
            for i, score in zip(b["_k"], b["score"], strict=True):
                m = np.asarray(score).reshape(n + 1, n)
                if i != own:
                    own, now, back = i, m[n], np.full(n, OPEN)
                else:
                    reach = now[:, None] + m[:n]
                    now, back = reach.max(axis=0), reach.argmax(axis=0)
                froms.append(back.astype(np.int32))
                ends.append(int(now.argmax()))
            yield pd.DataFrame({"_id": b["_id"], "part": b["part"], "_k": b["_k"], "froms": froms, "best": ends})

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = object(), OPEN
        for b in batches:
            before, lasts = [], []
            for i, froms, best in zip(b["_k"], b["froms"], b["best"], strict=True):
                if i != own:
                    own, last = i, int(best)
                lasts.append(last)
                last = int(froms[last])
                before.append(last)
            yield pd.DataFrame({"_id": b["_id"], "part": b["part"], "before": before, "last": lasts})

    scored = parts.mapInPandas(tables, f"{keys}, score array<double>").withColumn("_k", F.coalesce(F.col("_id").cast("string"), F.lit("")))
    scored = materialise(scored, "part-scores").repartition("_k").sortWithinPartitions("_k", "_id", "part")
    folded = materialise(scored.mapInPandas(forward, f"{keys}, _k string, froms array<int>, best int"), "part-froms")
    return folded.repartition("_k").sortWithinPartitions(F.desc("_k"), F.desc("_id"), F.desc("part")).mapInPandas(backward, f"{keys}, before int, last int")


def format_transcripts(df: DataFrame, model: RoleModel | None = None, text_col: str = "transcript", id_col: str | None = None, part_col: str | None = None) -> DataFrame:
    """``df`` with ``_n_turns, _continued, _roles, _texts, _rendered`` of each transcript.

    ``id_col`` and ``part_col``: rows with one id are parts of one conversation, in the order of their parts, and parsed as a whole.
    ``_roles`` and ``_texts`` are those of the turns that begin or go on in a row; ``_continued`` says whether the first goes on
    from the part before, ``_n_turns`` counts those that begin. A null or blank transcript has no turns and renders as an empty text. Text
    before the first marker gets the role that fits it best. Rows that repeat get equal results, where no parts are
    given; other columns are kept, but those with these names are replaced.
    """
    model = model or RoleModel()
    names = [c for c in df.columns if c not in ("_n_turns", "_continued", "_roles", "_texts", "_rendered")]
    rows = df.select(*names, F.lit(OPEN).alias("_before"), F.lit(OPEN).alias("_last"))
    if id_col and part_col:
        several = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(id_col).alias("_several"))
        several = bounded(materialise(several, "several-parts"), 16)
        own = F.col(id_col).eqNullSafe(F.col("_several"))
        many = df.select(*names).join(several, own, "left_semi")
        if not several.isEmpty():
            at = materialise(borders(many.select(F.col(id_col).alias("_id"), F.col(part_col).alias("part"), F.col(text_col).alias("transcript")), model), "borders")
            at = at.select(F.col("_id").alias("_bi"), F.col("part").alias("_bp"), F.col("before").alias("_before"), F.col("last").alias("_last"))
            met = many.join(bounded(at, 64), F.col(id_col).eqNullSafe(F.col("_bi")) & F.col(part_col).eqNullSafe(F.col("_bp")), "left")
            met = met.select(*names, F.coalesce("_before", F.lit(OPEN)).alias("_before"), F.coalesce("_last", F.lit(OPEN)).alias("_last"))
            rows = rows.join(several, own, "left_anti").unionByName(met)

    @F.pandas_udf("n_turns bigint, continued boolean, roles array<string>, texts array<string>, rendered string")
    def formatted(texts: pd.Series, before: pd.Series, last: pd.Series) -> pd.DataFrame:
        out = []
        for t, b, e in zip(texts, before, last, strict=True):
            lines = read_lines(t)
            continued, turns = turns_of(model.viterbi([(o, f) for o, f, _ in lines], int(b), int(e)), lines, OPEN if b == OPEN else int(b) // 2)
            out.append((len(turns) - continued, continued, [r for r, _ in turns], [x for _, x in turns], render(turns, continued)))
        return pd.DataFrame(out, columns=["n_turns", "continued", "roles", "texts", "rendered"])

    found = rows.select(*names, formatted(F.col(text_col), "_before", "_last").alias("_f"))
    return found.select(*names, *[F.col(f"_f.{c}").alias(f"_{c}") for c in ("n_turns", "continued", "roles", "texts", "rendered")])


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes each conversation as a transcript in one of several styles, a fifth of the markers left out, and recovers its turns.

    The model is fitted on the conversations outside fold 2. ``exact_roles``: all roles are as they were; ``exact``: all texts as well.
    """
    written = materialise(transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    found = format_transcripts(written.withColumnRenamed("roles", "true_roles"), fitted(written), id_col="_id", part_col="part")
    same = ~F.col("_continued") & (F.col("_roles") == F.col("true_roles"))
    part = F.concat_ws(".", F.col("part.cell").cast("string"), F.col("part.turn").cast("string"), F.col("part.piece").cast("string"))
    return found.select(
        F.col("_id").alias("conv_id"), part.alias("part"), F.coalesce(fold(F.col("_id")) == 2, F.lit(False)).alias("held_out"), F.col("_n_turns").alias("n_turns"), F.array_join("_roles", ",").alias("roles"),
        same.alias("exact_roles"), (same & (F.col("_texts") == F.col("texts"))).alias("exact"), F.col("_rendered").alias("rendered"),
    )
