"""Secret scans: fixed patterns, and credential formats inferred from what the patterns label.

The patterns' finds, over the whole corpus, are labelled credentials.  A bounded sample of them per
kind is made into a prefix tree over character classes, whose statistically compatible states of one
depth are merged into a probabilistic automaton.  States of different depths stay apart: a format's length and what
stands where are what tells it from a word of the same letters, and single samples are too thin
evidence to fold that away.  Every other candidate (what the patterns leave of a run of credential characters, and
its parts behind = and /) is scored by its likelihood under the automata against one inferred from
ordinary candidates.  Both sides are smoothed alike, step by step and as a whole, by the chain of
class pairs of their own samples; a candidate that leaves every credential automaton is none.

Unlabelled credentials stand among the ordinary candidates too.  Before the ordinary automaton is
inferred, samples that a credential automaton accepts and makes far likelier than the pair chain of the rest
are set aside, until none is left.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .common import ROW, carry

KINDS = ("assign", "access", "hex", "format")  # the last is the inferred one
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
KEYWORDS = ("passw", "secret", "token", "api")  # every match of ASSIGN holds one, in some case
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LABELLED_LENGTH = 6  # the shortest value that a pattern labels
CANDIDATE_LENGTH = 16  # of the shortest candidate, or that of the shortest labelled value if that is less
BEHIND = re.compile("[=/]")  # a value may start behind one of these

# The fit: labelled credentials per kind, and ordinary candidates, that a sample may hold.  Longer values are
# sampled too, by the doublings of SAMPLE_LENGTH that hold them, a quarter as many at each and one at least.
SAMPLE, SAMPLE_LENGTH = 4000, 128
APART = 3.1  # standard normal quantile of the likelihood-ratio test that keeps states apart
SMOOTH, ALONE = 0.02, 0.1  # share of the pair chain in every step of an automaton, and of the chain alone beside it
ROUNDS = 10  # of setting unlabelled credentials aside, at most
CAPITALS = 20  # one in so many ordinary samples counts in capitals too
THRESHOLD = math.log(1e6)  # how much likelier as a credential than as an ordinary candidate

CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "p": "+/_.=-"}
CAPITAL = str.maketrans("lh", "UH")
CLASS_OF = str.maketrans({c: k for k, members in CLASSES.items() for c in members})


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the patterns' finds, in that order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LABELLED_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


@lru_cache
def _runs_of(least: int) -> re.Pattern:
    return re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % least)


def candidates(text: str, least: int = CANDIDATE_LENGTH) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _runs_of(least).finditer(text)]


def all_base_spans(text: str, runs: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
    """The base finds with the hex ones, which all lie inside candidate runs."""
    found = base_spans(text)
    for start, _, run in runs:
        if len(run) >= 24:
            found += [(start + m.start(), 2, start + m.end(), start + m.start()) for m in HEX.finditer(run)]
    return sorted(found)


def _left(runs: list[tuple[int, int, str]], spans: list[tuple[int, int, int, int]], least: int) -> list[tuple[int, int, str]]:
    """What the spans leave of the runs, in pieces of ``least`` or more; both sides come by start."""
    out, k, reach = [], 0, 0
    for start, end, run in runs:
        at = max(start, reach)
        while k < len(spans) and spans[k][0] < end:
            if spans[k][0] - at >= least:
                out.append((at, spans[k][0], run[at - start:spans[k][0] - start]))
            reach = max(reach, spans[k][2])
            at = max(at, reach)
            k += 1
        if end - at >= least:
            out.append((at, end, run[at - start:]))
    return out


def _parts(run: str, least: int) -> list[tuple[int, int]]:
    """(start, end) of ``run``, of its tails behind each = and /, and of the parts between these, that
    have ``least`` or more; by start, longer ones first."""
    n = len(run)
    ends = [m.start() for m in BEHIND.finditer(run)]
    out = []
    for a, b in zip([0, *[e + 1 for e in ends]], [*ends, n]):
        if n - a < least:
            break
        out.append((a, n))
        if least <= b - a < n - a:
            out.append((a, b))
    return out


# --- the automata --------------------------------------------------------------------------------


START, END = "^", "$"
IMPOSSIBLE = -math.inf


@dataclass
class Chain:
    """How often each class, or the end, follows a class, with half a count more for each; and which
    pairs were seen."""

    log_next: dict[str, dict[str, float]]
    seen: set[tuple[str, str]]

    @classmethod
    def of(cls, samples: list[str]) -> Chain:
        pairs = Counter()
        for sample in samples:
            pairs.update(zip(START + sample, sample + END))
        log_next = {}
        for a in [START, *CLASSES]:
            row = {b: pairs[a, b] + 0.5 for b in [*CLASSES, END]}
            log_next[a] = {b: math.log(n / sum(row.values())) for b, n in row.items()}
        return cls(log_next, set(pairs))

    def log_likelihood(self, classes: str) -> float:
        return sum(self.log_next[a][b] for a, b in zip(START + classes, classes + END))


@dataclass
class Automaton:
    """Per state the probabilities of each class and of the end, the next states and the depth; per depth
    the most visited state that each class leads to from there; and the pair chain that smooths every step."""

    share: list[dict[str, float]]
    goto: list[dict[str, int]]
    depth: list[int]
    by_depth: list[dict[str, int]]
    chain: Chain

    def log_likelihood(self, classes: str, inside: bool = False) -> float:
        """Of the class string, by the automaton or, as a small share, by the chain alone.  Where a state has
        not seen the next class, its depth's main state for that class goes on; beyond what the depth
        has seen, the chain.  With ``inside`` that, and a pair of classes that no sample has, is minus infinity."""
        state, total, alone, last = 0, 0.0, 0.0, START
        for c in classes + END:
            back = self.chain.log_next[last][c]
            if inside and (last, c) not in self.chain.seen:
                return IMPOSSIBLE
            alone += back
            if state is None:
                total += back
            else:
                total += math.log((1 - SMOOTH) * self.share[state].get(c, 0.0) + SMOOTH * math.exp(back))
                if c != END:
                    after = self.goto[state].get(c)
                    state = self.by_depth[self.depth[state]].get(c) if after is None else after
                    if inside and state is None:
                        return IMPOSSIBLE
            last = c
        total, alone = total + math.log(1 - ALONE), alone + math.log(ALONE)
        return max(total, alone) + math.log1p(math.exp(-abs(total - alone)))


def infer(samples: list[str], apart: float = APART, chain: Chain | None = None) -> Automaton:
    """Merge compatible states of the prefix tree of class strings ``samples``.

    States already settled are tried as homes of states of their depth, most visited first; two states
    fit if a likelihood-ratio test keeps neither them nor any of their successors apart, by how often
    each class or the end follows.  A state that fits no settled one is settled itself.  The steps are
    smoothed by ``chain``, or by that of the samples."""
    visits, ends, edges, taken, depth = [0], [0], [{}], [{}], [0]
    for sample in samples:
        state = 0
        visits[0] += 1
        for c in sample:
            if c not in edges[state]:
                edges[state][c] = len(visits)
                visits.append(0), ends.append(0), edges.append({}), taken.append({}), depth.append(depth[state] + 1)
            taken[state][c] = taken[state].get(c, 0) + 1
            state = edges[state][c]
            visits[state] += 1
        ends[state] += 1
    limits = {}
    for free in range(1, len(CLASSES) + 1):  # chi-squared quantiles by Wilson and Hilferty
        limits[free] = free * (1 - 2 / (9 * free) + apart * math.sqrt(2 / (9 * free))) ** 3

    def alike(a: int, b: int) -> bool:
        n, m, ratio, outcomes = visits[a], visits[b], 0.0, 0
        for x, y in [(ends[a], ends[b]), *((taken[a].get(c, 0), taken[b].get(c, 0)) for c in taken[a].keys() | taken[b].keys())]:
            outcomes += x + y > 0
            ratio += (x and x * math.log(x / n)) + (y and y * math.log(y / m)) - (x + y and (x + y) * math.log((x + y) / (n + m)))
        return outcomes < 2 or 2 * ratio <= limits[outcomes - 1]

    def compatible(a: int, b: int) -> bool:
        stack, met = [(a, b)], set()
        while stack:
            pair = stack.pop()
            a, b = pair
            if a == b or pair in met:
                continue
            met.add(pair)
            if not alike(a, b):
                return False
            for c in edges[a].keys() & edges[b].keys():
                stack.append((edges[a][c], edges[b][c]))
        return True

    def fold(home: int, node: int) -> list[int]:
        stack, grown = [(home, node)], []
        while stack:
            a, b = stack.pop()
            grown.append(a)
            visits[a] += visits[b]
            ends[a] += ends[b]
            for c, target in edges[b].items():
                taken[a][c] = taken[a].get(c, 0) + taken[b][c]
                if c in edges[a]:
                    stack.append((edges[a][c], target))
                else:
                    edges[a][c] = target
        return grown

    # steps out of settled states, most visited first; one that a fold changes is put in again, and its old entry is passed over
    settled, known, level, steps = [0], {0}, {0: [0]}, []

    def put(s: int) -> None:
        for c, t in edges[s].items():
            if t not in known:
                heapq.heappush(steps, (-visits[t], s, c, t))

    put(0)
    while steps:
        count, parent, c, node = heapq.heappop(steps)
        if node in known or edges[parent][c] != node or visits[node] != -count:
            continue
        home = next((s for s in level.get(depth[node], []) if compatible(s, node)), None)
        if home is None:
            settled.append(node)
            known.add(node)
            level.setdefault(depth[node], []).append(node)
            put(node)
        else:
            edges[parent][c] = home
            for s in fold(home, node):
                if s in known:
                    put(s)
    index = {s: k for k, s in enumerate(settled)}
    by_depth: list[dict[str, int]] = [{} for _ in range(1 + max(depth[s] for s in settled))]
    for s in sorted(settled, key=lambda s: visits[s]):  # the most visited states come last and stay
        by_depth[depth[s]].update({c: index[t] for c, t in edges[s].items()})
    return Automaton([{c: taken[s][c] / visits[s] for c in edges[s]} | {END: ends[s] / visits[s]} for s in settled],
                     [{c: index[t] for c, t in edges[s].items()} for s in settled], [depth[s] for s in settled], by_depth,
                     chain or Chain.of(samples))


def infer_ordinary(samples: list[str], short: list[str], credentials: list[Automaton]) -> Automaton | None:
    """The automaton of ``samples`` without those that look like unlabelled credentials: accepted by an
    automaton and likelier by it, by the root of what a find takes, than by the pair chain of those that stay.  The chain is learnt from
    ``short`` ordinary runs too, which know more of what words look like, and from some of all in capitals,
    since any word may be written so.  None if no sample stays."""
    short = short + [x.translate(CAPITAL) for x in (samples + short)[::CAPITALS]]
    best = {x: max(a.log_likelihood(x, inside=True) for a in credentials) for x in samples}
    kept, chain = samples, Chain.of(samples + short)
    for _ in range(ROUNDS):
        again = [x for x in samples if best[x] <= chain.log_likelihood(x) + THRESHOLD / 2]
        if len(again) == len(kept):
            break
        kept, chain = again, Chain.of(again + short)
    return infer(kept, chain=chain) if kept else None


@dataclass
class Formats:
    """The inferred automata of credentials and of ordinary candidates."""

    credentials: list[Automaton]
    ordinary: Automaton
    scores: dict[str, float] = field(default_factory=dict)
    least: int = CANDIDATE_LENGTH

    def __post_init__(self) -> None:
        self.longest = max(max(a.depth) for a in self.credentials)  # a longer run leaves every automaton

    def score(self, run: str) -> float:
        """How much likelier, as a logarithm, the best credential format makes ``run``.  Inside a
        class both sides spread alike, so classes are enough."""
        if len(run) > self.longest:
            return IMPOSSIBLE
        classes = run.translate(CLASS_OF)
        if len(run) > SAMPLE_LENGTH:  # too long to keep
            return self._score(classes)
        if classes not in self.scores:
            if len(self.scores) > 200_000:
                self.scores.clear()
            self.scores[classes] = self._score(classes)
        return self.scores[classes]

    def _score(self, classes: str) -> float:
        best = max(a.log_likelihood(classes, inside=True) for a in self.credentials)
        return best - self.ordinary.log_likelihood(classes) if best > IMPOSSIBLE else IMPOSSIBLE

    def found(self, run: str, threshold: float) -> list[tuple[int, int]]:
        """(start, end) of the parts of ``run`` that pass, from the left, the longest first, none twice."""
        if self.score(run) >= threshold:
            return [(0, len(run))]
        out, at = [], 0
        for a, b in _parts(run, self.least)[1:]:
            if a >= at and b - a <= self.longest and self.score(run[a:b]) >= threshold:
                out.append((a, b))
                at = b
        return out


# --- over the corpus -----------------------------------------------------------------------------


LONG = 100  # between the kinds of one doubling and the next


def _doublings(length: int) -> int:
    """How often SAMPLE_LENGTH has to be doubled to hold ``length``."""
    return ((length - 1) // SAMPLE_LENGTH).bit_length()


def _share(kind: int, size: int) -> int:
    """How many values of a kind a sample holds: their characters halve from doubling to doubling."""
    return max(1, size >> 2 * (kind // LONG))


def _samples(size: int):
    """Per partition and kind the values with the smallest hashes; ordinary candidates are kind 3, and
    shorter ones by length in kinds of their own; values beyond SAMPLE_LENGTH have LONG more per doubling of it.
    Of ordinary runs that long, the whole and the parts between = and / are taken, not every tail, so that they cost
    no more than their length.  The length of the shortest labelled value is the hash of kind -1, of the longest that of kind -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[int, dict[str, int]] = defaultdict(dict)
        shortest, longest = CANDIDATE_LENGTH, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                runs = candidates(text, LABELLED_LENGTH)
                spans = all_base_spans(text, runs)
                for _, kind, end, value in spans:
                    shortest, longest = min(shortest, end - value), max(longest, end - value)
                    held[kind + LONG * _doublings(end - value)][text[value:end]] = 0
                for _, _, run in _left(runs, spans, LABELLED_LENGTH):
                    if len(run) < CANDIDATE_LENGTH and "=" not in run and "/" not in run:
                        held[3 + CANDIDATE_LENGTH - len(run)][run] = 0
                        continue
                    for a, b in _parts(run, LABELLED_LENGTH):
                        if b - a <= SAMPLE_LENGTH:
                            held[3 + max(0, CANDIDATE_LENGTH - (b - a))][run[a:b]] = 0
                        elif a == 0 or b < len(run):
                            held[3 + LONG * _doublings(b - a)][run[a:b]] = 0
            for kind, values in held.items():
                if len(values) > 4 * _share(kind, size):
                    held[kind] = _smallest(values, _share(kind, size), xxhash)
        rows = [(kind, v, xxhash.xxh64_intdigest(v.encode()) >> 1) for kind, values in held.items() for v in _smallest(values, _share(kind, size), xxhash)]
        if rows:
            rows += [(-1, "", shortest), (-2, "", longest)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64()))],
                                             names=["kind", "value", "hash"])

    return run


def _smallest(values: dict[str, int], size: int, xxhash) -> dict[str, int]:
    return dict.fromkeys(sorted(values, key=lambda v: (xxhash.xxh64_intdigest(v.encode()) >> 1, v))[:size], 0)


def learn(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE) -> Formats | None:
    """Formats from all of ``docs``: per kind the ``sample`` distinct values with the smallest hashes,
    whatever the partitions, and as many ordinary candidates and shorter ordinary runs; where longer values than
    SAMPLE_LENGTH are labelled, samples of those and of ordinary candidates up to their length too.  None where nothing
    is labelled or no ordinary candidate is there to compare with."""
    found = write_through(docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(
        _samples(sample), "kind long, value string, hash long").distinct(), "secret-samples")
    best = found.where("kind = -1").orderBy("hash").limit(1).unionAll(found.where("kind = -2").orderBy(F.desc("hash")).limit(1))
    for kind in range(3):
        best = best.unionAll(found.where(F.col("kind") == kind).orderBy("hash", "value").limit(sample))
    values: list[list[str]] = [[], [], []]
    least, longest = CANDIDATE_LENGTH, 0
    for row in best.collect():  # at most three samples
        if row["kind"] == -1:
            least = row["hash"]
        elif row["kind"] == -2:
            longest = row["hash"]
        else:
            values[row["kind"]].append(row["value"])
    ordinary_long = []
    for kind in (k + LONG * d for d in range(1, _doublings(max(longest, 1)) + 1) for k in range(len(KINDS))):
        more = [row["value"] for row in found.where(F.col("kind") == kind).orderBy("hash", "value").limit(_share(kind, sample)).collect()]
        (values[kind % LONG] if kind % LONG < 3 else ordinary_long).extend(more)
    if not any(values[:3]):
        return None
    last = 3 + CANDIDATE_LENGTH - least  # the kind of ordinary runs as short as the shortest labelled value
    for part in (F.col("kind").between(3, last), F.col("kind").between(last + 1, LONG - 1)):
        values.append([row["value"].translate(CLASS_OF) for row in found.where(part).orderBy("hash", "value").limit(sample).collect()])  # at most a sample
    credentials = [infer(sorted(v.translate(CLASS_OF) for v in kind)) for kind in values[:3] if kind]
    values[-2] += [v.translate(CLASS_OF) for v in ordinary_long if len(v) <= longest]
    ordinary = infer_ordinary(sorted(values[-2]), values[-1], credentials)
    return Formats(credentials, ordinary, least=least) if ordinary else None


def scan_text(text: str, formats: Formats | None, threshold: float = THRESHOLD) -> tuple[list, list]:
    """(base spans, all spans), each (start, kind, end, start of the value) in order."""
    runs = candidates(text, formats.least if formats else CANDIDATE_LENGTH)
    base = all_base_spans(text, runs)
    if formats is None:
        return base, base
    more = [(at + a, 3, at + b, at + a) for at, _, run in _left(runs, base, formats.least) for a, b in formats.found(run, threshold)]
    return base, sorted(base + more) if more else base


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE,
         threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format for every row.

    A null text counts as empty and has no span; ids may be null; repeated rows are scanned alike;
    extra columns are not read; an empty table gives no rows."""
    formats = learn(docs, text_column, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                        ("base_sha256", pa.string()), ("spans", pa.string()), ("n_format", pa.int64())])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, spans = scan_text(text or "", formats, threshold)
                if not spans:
                    rows.append((doc, 0, 0, 0, nothing, "", 0))
                    continue
                counts = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((doc, *counts[:3], hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), counts[3]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def redact_text(text: str, spans: list) -> str:
    """The text with the values of all spans replaced by one mark each."""
    out, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in spans):
        if end <= at:
            continue
        out += [text[at:max(at, start)], "[SECRET]"] if start >= at else []
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_column: str = "text", chars_column: str | None = "n_chars", sample: int = SAMPLE,
           threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns with the values of all found secrets replaced; ``chars_column``,
    if it is there, holds the new length of changed texts.  Null texts stay null."""
    formats = learn(docs, text_column, sample)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redact_text(t, s) if (s := scan_text(t, formats, threshold)[1]) else t
                         for t in texts.to_pylist()], pa.string())

    texts = F.col(ROW).getField(text_column)
    new = carry(docs, clean=clean(F.col(text_column).cast("string")))
    columns = {c: F.col(ROW).getField(c) for c in docs.columns}
    if chars_column in columns:
        columns[chars_column] = F.when(F.col("clean") != texts, F.char_length("clean").cast("long")).otherwise(columns[chars_column])
    columns[text_column] = F.col("clean")
    return new.select(*[column.alias(name) for name, column in columns.items()])
