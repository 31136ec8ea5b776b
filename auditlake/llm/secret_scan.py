"""Secret scan: all rules run as one minimal deterministic automaton over the bytes of a text.

The regexes of the rules become position sets; subset construction over byte classes and minimisation give transition arrays that
every task holds. A text is read once, byte by byte, for all rules; texts are cut into lanes at bytes that lead every state back to
the start, and the lanes of a batch step side by side. States tell where a rule accepts and where it has nothing open; only
between two such places around an accepting one is the rule's own anchored automaton walked, to settle where its matches begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from auditlake.llm.common import short_batches, table


@dataclass(frozen=True)
class Rule:
    """A match is head, then as many characters of run as follow, one at least (without run, head alone). It counts if run has
    least characters. fold: letters of head in either case."""

    kind: str
    head: str
    run: str = ""
    least: int = 1
    fold: bool = False


# The rules. The first three are the base; the others add spans of their own kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
MORE = (
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("url", "://[A-Za-z0-9._~-]+:[A-Za-z0-9._~-]+@"),
)
RULES = BASE + MORE

#: Bytes of a lane after which it is cut, bytes of text scanned at once, and lanes below which they are read one by one.
LANE_BYTES, SLICE_BYTES, FEW_LANES = 2_048, 1 << 21, 24
#: Most states of an automaton; rules that need more are refused.
MOST_STATES = 60_000


# ---------------------------------------------------------------- regexes to position sets


class _Pattern:
    """Reads literals, classes, groups, |, *, +, ? and {m}, {m,} into a tree over byte masks."""

    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold = text, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        arms = [self.row()]
        while self.peek() == "|":
            self.take()
            arms.append(self.row())
        return arms[0] if len(arms) == 1 else ("or", arms)

    def row(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.single()))
        return ("row", parts)

    def repeated(self, node):
        mark = self.peek()
        if mark in ("*", "+", "?") and mark:
            self.take()
            return {"*": ("star", node), "+": ("row", [node, ("star", node)]), "?": ("or", [node, ("row", [])])}[mark]
        if mark == "{":
            low, _, rest = self.text[self.at + 1 : self.text.index("}", self.at)].partition(",")
            open_end = "," in self.text[self.at : self.text.index("}", self.at)]
            if rest:
                raise ValueError(f"only {{m}} and {{m,}} are known: {self.text}")
            self.at = self.text.index("}", self.at) + 1
            return ("row", [node] * int(low) + ([("star", node)] if open_end else []))
        return node

    def byte(self) -> int:
        sign = self.take()
        if sign == "\\" and self.peek() == "x":
            self.at += 3
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(self.take() if sign == "\\" else sign)

    def single(self):
        if self.peek() == "(":
            self.take()
            node = self.either()
            self.take()
            return node
        if self.peek() != "[":
            return ("byte", self.folded({self.byte()}))
        self.take()
        chosen = set()
        while self.peek() != "]":
            low = self.byte()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                chosen |= set(range(low, self.byte() + 1))
            else:
                chosen.add(low)
        self.take()
        return ("byte", self.folded(chosen))

    def folded(self, chosen: set[int]) -> frozenset[int]:
        return frozenset(chosen | {ord(chr(b).swapcase()) for b in chosen if chr(b).isascii() and chr(b).isalpha()} if self.fold else chosen)


class _Positions:
    """Position sets of several patterns: the bytes and followers of each position, where a pattern begins and where it ends."""

    def __init__(self):
        self.bytes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def add(self, node) -> tuple[bool, set[int], set[int]]:
        """(may be empty, first positions, last positions) of a tree."""
        kind, body = node
        if kind == "byte":
            self.bytes.append(body)
            self.follow.append(set())
            return False, {len(self.bytes) - 1}, {len(self.bytes) - 1}
        if kind == "or":
            arms = [self.add(arm) for arm in body]
            return any(a[0] for a in arms), set().union(*(a[1] for a in arms)), set().union(*(a[2] for a in arms))
        if kind == "star":
            _, first, last = self.add(body)
            for p in last:
                self.follow[p] |= first
            return True, first, last
        empty, first, last = True, set(), set()
        for part in body:
            none, begins, ends = self.add(part)
            for p in last:
                self.follow[p] |= begins
            first = first | begins if empty else first
            last = last | ends if none else ends
            empty = empty and none
        return empty, first, last


@dataclass
class Automaton:
    """Transition array states x byte classes, class of each byte, and for each state the bit sets of the tags that accept in it and
    of the tags that have nothing open in it. State 0 is the start; dead is the state that nothing leaves, or -1."""

    step: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray
    idle: np.ndarray
    dead: int

    @property
    def resets(self) -> np.ndarray:
        """True for bytes that lead every state to the start."""
        return (self.step == 0).all(axis=0)[self.classes]


def determinise(patterns: list[tuple[str, bool]], anchored: bool) -> Automaton:
    """Minimal automaton of all patterns (regex, fold), the k-th with tag bit k. Anchored: a match begins at the start; otherwise
    it may begin anywhere, and a state holds every match that is open."""
    spots = _Positions()
    firsts, ends, owner = [], [], []
    for text, fold in patterns:
        empty, first, last = spots.add(_Pattern(text, fold).either())
        if empty:
            raise ValueError(f"{text} matches nothing")
        firsts.append(first)
        ends.append(last)
        owner += [len(firsts) - 1] * (len(spots.bytes) - len(owner))
    kinds = list(dict.fromkeys(spots.bytes))
    signs = np.zeros((256, len(kinds)), bool)
    for k, members in enumerate(kinds):
        signs[list(members), k] = True
    shapes, classes = np.unique(signs, axis=0, return_inverse=True)
    classes = classes.reshape(-1).astype(np.uint8)
    allowed = [frozenset(p for p, b in enumerate(spots.bytes) if shapes[c][kinds.index(b)]) for c in range(len(shapes))]
    begin = frozenset().union(*firsts)
    start = frozenset([-1]) if anchored else frozenset()
    states, queue, rows = {start: 0}, [start], []
    for state in queue:
        nexts = set() if anchored else set(begin)
        for p in state:
            nexts |= begin if p < 0 else spots.follow[p]
        row = []
        for c in range(len(shapes)):
            to = frozenset(nexts & allowed[c])
            if to not in states:
                if len(states) == MOST_STATES:
                    raise ValueError(f"the rules need more than {MOST_STATES} states")
                states[to] = len(states)
                queue.append(to)
            row.append(states[to])
        rows.append(row)
    step = np.array(rows, np.int32)
    accepts, idle = np.zeros(len(queue), np.int64), np.zeros(len(queue), np.int64)
    for number, state in enumerate(queue):
        held = {owner[p] for p in state if p >= 0}
        accepts[number] = sum(1 << k for k, end in enumerate(ends) if end & state)
        idle[number] = sum(1 << k for k in range(len(ends)) if k not in held)
    step, accepts, idle = _minimal(step, accepts, idle)
    dead = np.flatnonzero((step == np.arange(len(step))[:, None]).all(axis=1) & (accepts == 0)) if anchored else []
    return Automaton(step, classes, accepts, idle, int(dead[0]) if len(dead) else -1)


def _minimal(step: np.ndarray, accepts: np.ndarray, idle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge states that no text tells apart: blocks of equal marks are split until equal blocks go to equal blocks."""
    _, block = np.unique(np.stack([accepts, idle], axis=1), axis=0, return_inverse=True)
    block, count = block.reshape(-1), 0
    while block.max() + 1 > count:
        count = int(block.max()) + 1
        rows = np.ascontiguousarray(np.column_stack([block, block[step]]).astype(np.int32))
        _, block = np.unique(rows.view(np.dtype((np.void, rows.strides[0]))).reshape(-1), return_inverse=True)
    # number blocks by their first state, so that the start stays 0
    _, first, block = np.unique(block, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    chosen = np.sort(first)
    return rank[block.reshape(-1)[step[chosen]]].astype(np.int32), accepts[chosen], idle[chosen]


class Scanner:
    """The combined automaton, which marks where a match of a rule may end, and for each rule an anchored one with tags 1 (a match) and
    2 (a match that counts)."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        counted = [(r.head + (f"{r.run}{{{r.least},}}" if r.run else ""), r.fold) for r in rules]
        every = [(r.head + (f"{r.run}+" if r.run else ""), r.fold) for r in rules]
        # a rare head marks a place well enough; counting its run too would multiply the states of all rules
        self.all = determinise([e if r.head else c for r, e, c in zip(rules, every, counted, strict=True)], False)
        self.each = [determinise([e, c], True) for e, c in zip(every, counted, strict=True)]
        self.lists = [(a.step.tolist(), a.classes.tolist(), a.accepts.tolist()) for a in self.each]

    def states(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """State of the combined automaton after each byte; the text r is data[bounds[r]:bounds[r + 1]]."""
        automaton, out = self.all, np.empty(len(data), np.int32)
        width, step = automaton.step.shape[1], automaton.step.reshape(-1)
        codes = automaton.classes[data]
        starts = self._lanes(data, bounds)
        sizes = np.diff(np.append(starts, len(data)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        now, at, live = np.zeros(len(starts), np.int32), 0, len(starts)
        while live:
            while live and sizes[live - 1] <= at:
                live -= 1
            if live < FEW_LANES:
                break
            # all lanes that live take the same number of steps before the next one ends
            for k in range(at, int(sizes[live - 1])):
                places = starts[:live] + k
                now[:live] = step[now[:live] * width + codes[places]]
                out[places] = now[:live]
            at = int(sizes[live - 1])
        if live:
            rows = automaton.step.tolist()
            for lane in range(live):
                state, a, b = int(now[lane]), int(starts[lane]) + at, int(starts[lane] + sizes[lane])
                found = []
                for code in codes[a:b].tolist():
                    state = rows[state][code]
                    found.append(state)
                out[a:b] = found
        return out

    def _lanes(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of lanes: of every text, and after a byte that resets the automaton whenever a lane has LANE_BYTES."""
        edges = np.unique(bounds[:-1][bounds[:-1] < bounds[1:]])
        long = edges[np.diff(np.append(edges, len(data))) > LANE_BYTES]
        if not len(long):
            return edges
        safe = np.flatnonzero(self.all.resets[data]) + 1
        # of the safe places the first in every stretch of LANE_BYTES
        safe = safe[np.concatenate([[True], safe[1:] // LANE_BYTES > safe[:-1] // LANE_BYTES])] if len(safe) else safe
        return np.unique(np.concatenate([edges, safe[safe < len(data)]]))

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(text, [(start, rule, end)]) of the texts that hold matches that count; places in code points, ordered."""
        if not len(data):
            return
        states = self.states(data, bounds)
        marks = self.all.accepts[states]
        hits = np.flatnonzero(marks)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for rule in range(len(self.rules)):
            mine = hits[(marks[hits] >> rule) & 1 == 1]
            if not len(mine):
                continue
            closed = np.flatnonzero((self.all.idle[states] >> rule) & 1)
            text = np.searchsorted(bounds, mine, side="right") - 1
            k = np.searchsorted(closed, mine)
            low = np.where(k > 0, closed[np.maximum(k, 1) - 1] + 1 if len(closed) else 0, 0)
            high = np.where(k < len(closed), closed[np.minimum(k, len(closed) - 1)] if len(closed) else len(data), len(data))
            regions = np.unique(np.stack([text, np.maximum(low, bounds[text]), np.minimum(high, bounds[text + 1])], axis=1), axis=0)
            for row, a, b in regions.tolist():
                found.setdefault(row, []).extend((a + s, rule, a + e) for s, e in self._settle(rule, data[a:b].tobytes()))
        for row in sorted(found):
            own = sorted(found[row])
            if own:
                base = int(bounds[row])
                points = np.concatenate([[0], np.cumsum(data[base : int(bounds[row + 1])] & 0xC0 != 0x80)])
                yield row, [(int(points[s - base]), rule, int(points[e - base])) for s, rule, e in own]

    def _settle(self, rule: int, region: bytes) -> Iterator[tuple[int, int]]:
        """Matches that count among the leftmost longest ones of a region that no match crosses."""
        rows, classes, accepts = self.lists[rule]
        dead, at, size = self.each[rule].dead, 0, len(region)
        while at < size:
            state, place, end, counts = 0, at, -1, False
            while place < size:
                state = rows[state][classes[region[place]]]
                if state == dead:
                    break
                place += 1
                if accepts[state]:
                    end, counts = place, accepts[state] & 2 == 2
            if end < 0:
                at += 1
                continue
            if counts:
                yield at, end
            at = end


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


# ---------------------------------------------------------------- over documents


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of rows of about SLICE_BYTES."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
        yield at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc, spans): each row of docs as a struct and the spans of its text, an array of (kind, start, end) in code points, end
    exclusive, by start and then by the order of rules.

    Of each rule the matches are leftmost, as long as possible and don't overlap; those with too short a run are dropped, and what
    they cover is not looked at again. Spans of different rules may overlap. Odd rows: null and empty texts have no spans;
    repeated rows and null ids are rows like others; texts of any length are read whole; other columns keep their values and names
    inside doc; an empty table gives no rows."""
    spark = docs.sparkSession
    short_batches(spark)
    sent = spark.sparkContext.broadcast(scanner(rules))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text")
    out = StructType().add("doc", rows.schema["doc"].dataType).add("spans", ArrayType(StructType().add("kind", "string").add("start", "long").add("end", "long")))
    kinds = [r.kind for r in rules]

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), pa.scalar("", pa.large_string()))
            sizes, flat = np.zeros(batch.num_rows, np.int64), []
            for first, data, bounds in _slices(texts):
                for row, spans in sent.value.spans(data, bounds):
                    sizes[first + row] = len(spans)
                    flat += spans
            values = pa.StructArray.from_arrays(
                [pa.array([kinds[s[1]] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64())], ["kind", "start", "end"]
            )
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)], ["doc", "spans"])

    return rows.mapInArrow(run, out)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(*kinds: str) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.size(_of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc.doc_id", *counts, F.sha2(listed(_of(*(r.kind for r in BASE))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _either(words: str) -> str:
    """A regex in which each letter matches in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# (kind, order, regex, condition on the match m) as plain SQL has them
_SQL_RULES = (
    ("assign", 1, rf"""({_either("password|passwd|secret|token|api_?key")})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
     rf"""length(regexp_replace(m, '^({_either("password|passwd|secret|token|api_?key")})["'']?\x20*[:=]\x20*["'']?', '')) >= 6"""),
    ("access", 2, "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", 3, "[0-9a-f]+", "length(m) >= 24"),
    ("private", 4, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    ("github", 5, "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    ("slack", 6, "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
    ("url", 7, "://[A-Za-z0-9._~-]+:[A-Za-z0-9._~-]+@", "true"),
)
#: Plain form: the texts between a rule's matches and the matches themselves, laid end to end, give the places.
OP13_SQL = "WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),\n" + ",\n".join(
    f"{kind} AS (SELECT r, i, m, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (\n"
    f"  SELECT r, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i\n"
    f"  FROM (SELECT r, regexp_extract_all(t, '{regex}') AS ms, string_split_regex(t, '{regex}') AS gs FROM texts) WHERE len(ms) > 0))"
    for kind, _, regex, _ in _SQL_RULES
) + ",\nspans AS (\n" + "\nUNION ALL\n".join(
    f"  SELECT r, '{kind}' AS kind, {order} AS o, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM {kind} WHERE {holds}" for kind, order, _, holds in _SQL_RULES
) + """)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (o = 1) AS n_assign, count(*) FILTER (o = 2) AS n_access, count(*) FILTER (o = 3) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o <= 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o IS NOT NULL), '') AS spans
FROM texts LEFT JOIN spans USING (r) GROUP BY r
"""

QUERIES = {"op13_secret_scan": op13_secret_scan}
ORACLES = {"op13_secret_scan": OP13_SQL}
