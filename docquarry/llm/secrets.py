"""Secret scan by inferred grammars.

Credentials that fixed patterns find with certainty are labelled examples. Their characters are mapped
to a few classes. A bounded sample of distinct examples is grouped by form, since one key name stands before
many formats: alphabet, signs between, leading word, and length where many examples have it. For every form a
prefix tree with counts is built. States whose outgoing and ending frequencies do not differ significantly
(Hoeffding bound, down to all common descendants) are merged, breadth first, into a probabilistic
automaton: the grammar of the format. Every other candidate (a run of credential characters of enough
length, or a part of it between such examples) is scored by the logarithm of its likelihood under the
best automaton over its likelihood under a background chain. Candidates far enough above the background
that mix letters and digits are reported as kind ``format``. The chain's class pairs are counted over the
distinct candidates of all texts, each once however often it occurs, in two steps: first over those made
of ordinary words and numbers, then also over the others that no automaton favours over the first count,
so that credentials do not become background by their number.

Defined results: null text is scanned as empty and has no spans; repeated rows are scanned each; without
examples (or without rows) there is no automaton and no ``format`` span; offsets are code points, ends
exclusive; whole texts are scanned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from math import log, log2, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.session import materialise

KINDS = ("assign", "access", "hex", "format")

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
_HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)  # the runs of HEX that are long enough

# Words in lower case, upper case or with a capital, and numbers, between other signs.
_ORDINARY = re.compile(r"[+/=_.-]*(?:(?:[a-z]++|[A-Z][a-z]++|[A-Z]++|[0-9]++)(?:[+/=_.-]++|\Z))+")


@dataclass(frozen=True)
class SecretRules:
    """``max_labels``: distinct examples per kind an automaton is inferred from (those with the smallest hashes).

    ``min_form``: examples that make a form of their own; rarer ones are put together with the rest of their kind.
    ``alpha``: error level of the merge test. ``min_bits``, ``min_bits_per_char``: required log2 ratio to the background.
    """

    max_labels: int = 1000
    min_form: int = 10
    alpha: float = 0.05
    min_length: int = 12
    min_bits: float = 24.0
    min_bits_per_char: float = 0.75


_CLASSES = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"),
            **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U"),
            **dict.fromkeys("+/=", "+"), **dict.fromkeys("_-", "-"), ".": "."}
_TO_CLASS = str.maketrans(_CLASSES)
SYMBOLS = sorted(set(_CLASSES.values()))
_UNSEEN = 0.01  # pseudo-count of symbols a state has not seen


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of the fixed patterns, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(2, *m.span(), m[0]) for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple], min_length: int) -> list[tuple[int, int, str]]:
    """(start, end, run) of maximal runs of credential characters outside base spans."""
    runs = re.finditer(r"[A-Za-z0-9+/_.=-]{%d,}" % min_length, text)
    if not base:
        return [(*m.span(), m[0]) for m in runs]
    free, i, reach = [], 0, 0
    for m in runs:
        start = max(m.start(), reach)
        while i < len(base) and base[i][1] < m.end():
            if base[i][1] - start >= min_length:
                free.append((start, base[i][1], text[start : base[i][1]]))
            reach = max(reach, base[i][2])
            start = max(start, reach)
            i += 1
        if m.end() - start >= min_length:
            free.append((start, m.end(), text[start : m.end()]))
    return free


@dataclass
class Automaton:
    """States with the count of visits, of ends, and per symbol (target, count)."""

    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, list]] = field(default_factory=lambda: [{}])

    @staticmethod
    def prefix_tree(words: Iterable[str]) -> Automaton:
        tree = Automaton()
        for word in words:
            state = 0
            tree.visits[0] += 1
            for symbol in word:
                move = tree.moves[state].get(symbol)
                if move is None:
                    move = tree.moves[state][symbol] = [len(tree.visits), 0]
                    tree.visits.append(0)
                    tree.ends.append(0)
                    tree.moves.append({})
                move[1] += 1
                state = move[0]
                tree.visits[state] += 1
            tree.ends[state] += 1
        return tree

    def differ(self, a: int, b: int, bound: float) -> bool:
        """True when the two states, or states reached from both by the same symbols, differ significantly."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.visits[x], self.visits[y]
            margin = bound * (1 / sqrt(n) + 1 / sqrt(m))
            if margin >= 1:
                continue  # too few visits to tell here, and fewer further down
            if abs(self.ends[x] / n - self.ends[y] / m) >= margin:
                return True
            ours, theirs = self.moves[x], self.moves[y]
            for symbol in ours.keys() | theirs.keys():
                i, j = ours.get(symbol), theirs.get(symbol)
                if abs((i[1] if i else 0) / n - (j[1] if j else 0) / m) >= margin:
                    return True
                if i and j:
                    todo.append((i[0], j[0]))
        return False

    def fold(self, kept: int, tree: int) -> None:
        """Add the counts of the tree below ``tree`` to the states that the same symbols reach from ``kept``."""
        todo = [(kept, tree)]
        while todo:
            x, y = todo.pop()
            self.visits[x] += self.visits[y]
            self.ends[x] += self.ends[y]
            for symbol, (target, count) in self.moves[y].items():
                own = self.moves[x].get(symbol)
                if own is None:
                    self.moves[x][symbol] = [target, count]
                else:
                    own[1] += count
                    todo.append((own[0], target))

    @staticmethod
    def infer(words: Iterable[str], alpha: float) -> Automaton:
        """Prefix tree of the words with compatible states merged."""
        machine, bound = Automaton.prefix_tree(words), sqrt(0.5 * log(2 / alpha))
        settled, members = [0], {0}
        while True:
            # The fringe: the first state, breadth first, that hangs on a settled state and is none itself.
            edge = next(((s, c) for s in settled for c in sorted(machine.moves[s]) if machine.moves[s][c][0] not in members), None)
            if edge is None:
                return machine._compact(settled)
            move = machine.moves[edge[0]][edge[1]]
            fringe = move[0]
            for state in settled:
                if not machine.differ(state, fringe, bound):
                    move[0] = state
                    machine.fold(state, fringe)
                    break
            else:
                settled.append(fringe)
                members.add(fringe)

    def _compact(self, states: list[int]) -> Automaton:
        place = {s: i for i, s in enumerate(states)}
        return Automaton(
            [self.visits[s] for s in states], [self.ends[s] for s in states],
            [{c: [place[t], n] for c, (t, n) in self.moves[s].items()} for s in states],
        )

    def bits(self, word: str) -> float:
        """log2 of the word's likelihood; an unseen symbol leaves the state as it is."""
        state, total = 0, 0.0
        for symbol in word:
            move = self.moves[state].get(symbol)
            total += log2(((move[1] if move else 0) + _UNSEEN) / (self.visits[state] + _UNSEEN * (len(SYMBOLS) + 1)))
            state = move[0] if move else state
        return total + log2((self.ends[state] + _UNSEEN) / (self.visits[state] + _UNSEEN * (len(SYMBOLS) + 1)))


@dataclass(frozen=True)
class SecretModel:
    """Automata, one per form, and the background."""

    automata: tuple[Automaton, ...]
    background: dict[str, int]  # counts of class pairs; "^" begins and "$" ends a candidate

    def __post_init__(self):
        after: Counter = Counter()
        for pair, count in self.background.items():
            after[pair[0]] += count
        choices = len(SYMBOLS) + 1
        chain = {
            a + b: log2((self.background.get(a + b, 0) + 1) / (after[a] + choices)) for a in ["^", *SYMBOLS] for b in [*SYMBOLS, "$"]
        }
        object.__setattr__(self, "_chain", chain)

    def gain(self, word: str) -> float:
        """Bits that the best automaton saves over the background, for a word of classes."""
        usual = sum(self._chain[a + b] for a, b in zip("^" + word, word + "$"))
        return max((machine.bits(word) for machine in self.automata), default=usual) - usual

    def is_credential(self, run: str, rules: SecretRules) -> bool:
        word = run.translate(_TO_CLASS)
        if not self.automata or "d" not in word or not ({"h", "l", "H", "U"} & set(word)):
            return False
        gain = self.gain(word)
        return gain >= rules.min_bits and gain >= rules.min_bits_per_char * len(word)


_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_FOUND = T.StructType([
    T.StructField("base", T.ArrayType(T.StructType([*_SPAN.fields, T.StructField("secret", T.StringType())]))),
    T.StructField("rest", T.ArrayType(T.StructType([*_SPAN.fields[1:], T.StructField("run", T.StringType())]))),
])


def scanned(text: Column, rules: SecretRules = SecretRules()) -> Column:
    """A struct of the ``base`` spans with their secrets and the ``rest``: other candidates."""

    @F.arrow_udf(_FOUND)
    def scan(column: pa.Array) -> pa.Array:
        base, rest = [], []
        for text in column.to_pylist():
            spans = base_spans(text or "")
            base.append([dict(zip(("kind", "start", "end", "secret"), s)) for s in spans])
            rest.append([dict(zip(("start", "end", "run"), c)) for c in candidates(text or "", spans, rules.min_length)])
        span = [("start", pa.int32()), ("end", pa.int32())]
        return pa.StructArray.from_arrays([
            pa.array(base, pa.list_(pa.struct([("kind", pa.int32()), *span, ("secret", pa.string())]))),
            pa.array(rest, pa.list_(pa.struct([*span, ("run", pa.string())]))),
        ], ["base", "rest"])

    return scan(text)


def form_of(secret: str) -> tuple:
    """Alphabet, signs between letters and digits, and the leading word before the first sign, for credentials of one make."""
    classes = set(secret.translate(_TO_CLASS))
    lower = "all" if "l" in classes else "hex" if "h" in classes else ""
    upper = "all" if "U" in classes else "hex" if "H" in classes else ""
    lead = re.match(r"[A-Za-z]{2,8}(?=[_-])", secret)
    return lower, upper, "d" in classes, "".join(sorted(classes - set("dhlHU"))), lead[0] if lead else ""


def by_form(secrets: Iterable[str], least: int) -> list[list[str]]:
    """Examples of one kind grouped by form, then by length where ``least`` of a form have it; rarer ones make one group."""
    forms: dict[tuple, list[str]] = {}
    for secret in secrets:
        forms.setdefault(form_of(secret), []).append(secret)
    groups, rest = [], []
    for form in sorted(forms):
        lengths = Counter(map(len, forms[form]))
        own = sorted(n for n, count in lengths.items() if count >= least)
        groups += [[s for s in forms[form] if len(s) == n] for n in own]
        others = [s for s in forms[form] if len(s) not in own]
        if len(others) >= least:
            groups.append(others)
        else:
            rest += others
    return groups + [rest] if rest else groups


def label_sample(found: DataFrame, rules: SecretRules = SecretRules()) -> dict[int, list[str]]:
    """Per kind the ``max_labels`` distinct labelled secrets with the smallest hashes.

    The share of the hashes that holds them is estimated from the number of secrets, ten deviations above what is needed,
    so a little more than the sample comes to the driver however many tasks there are, and no task ranks a kind.
    """
    labels = found.select(F.explode("base").alias("b")).select("b.kind", "b.secret").distinct()
    labels = materialise(labels.withColumn("hash", F.xxhash64("secret")), "secret-labels")
    sizes = {r["kind"]: r["n"] for r in labels.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    wanted, sample = rules.max_labels + 10 * sqrt(rules.max_labels) + 100, {}
    while sizes:
        share = {kind: min(1.0, wanted / n) for kind, n in sizes.items()}
        near = F.lit(False)
        for kind, part in share.items():
            limit = (1 << 63) - 1 if part >= 1 else int(part * 2.0**64) - (1 << 63)
            near = near | ((F.col("kind") == kind) & (F.col("hash") <= limit))
        for kind, secret, key in labels.filter(near).select("kind", "secret", "hash").collect():
            sample.setdefault(kind, []).append((key, secret))
        short = {kind for kind in sizes if share[kind] < 1 and len(sample.get(kind, ())) < rules.max_labels}
        for kind in short:
            sample.pop(kind, None)
        sizes, wanted = {kind: sizes[kind] for kind in short}, 2 * wanted
    return {kind: [s for _, s in sorted(found)[: rules.max_labels]] for kind, found in sample.items()}


def learn(found: DataFrame, rules: SecretRules = SecretRules()) -> SecretModel:
    """Automata from a bounded sample of the labelled secrets, the background from all distinct candidates.

    ``found`` has the columns ``base`` and ``rest`` of ``scanned``. To the driver come a bounded number of strings per kind
    and one count per pair of classes.
    """
    sample = label_sample(found, rules)
    groups = [group for kind in sorted(sample) for group in by_form(sample[kind], rules.min_form)]
    automata = tuple(Automaton.infer([s.translate(_TO_CLASS) for s in group], rules.alpha) for group in groups)

    runs = materialise(found.select(F.explode("rest.run").alias("run")).distinct(), "secret-runs")

    def background(ordinary: Callable[[str], bool]) -> dict[str, int]:
        def count_pairs(batches):
            counts: Counter = Counter()
            for batch in batches:
                for run in batch.column(0).to_pylist():
                    if ordinary(run):
                        word = run.translate(_TO_CLASS)
                        counts.update(map(str.__add__, "^" + word, word + "$"))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])

        pairs = runs.mapInArrow(count_pairs, "pair string, n bigint")
        return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}

    first = SecretModel(automata, background(lambda run: bool(_ORDINARY.fullmatch(run))))
    return SecretModel(automata, background(lambda run: bool(_ORDINARY.fullmatch(run)) or first.gain(run.translate(_TO_CLASS)) <= 0))


def scored(rest: Column, model: SecretModel, rules: SecretRules = SecretRules()) -> Column:
    """The candidates that the automata take for credentials, as spans of kind ``format``."""

    @F.arrow_udf(T.ArrayType(_SPAN))
    def score(column: pa.Array) -> pa.Array:
        spans = [
            [{"kind": 3, "start": c["start"], "end": c["end"]} for c in row or () if model.is_credential(c["run"], rules)]
            for row in column.to_pylist()
        ]
        return pa.array(spans, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))

    return score(rest)


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SecretRules = SecretRules()
) -> DataFrame:
    """Per row: id, ``base`` spans and ``spans`` (base and ``format``), each (kind, start, end) by start, then kind.

    Texts are read once; spans and candidates are stored between the steps.
    """
    found = materialise(docs.select(F.col(id_col), scanned(F.col(text_col), rules).alias("f")).select(id_col, "f.*"), "secret-candidates")
    model = learn(found, rules)
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    rows = found.select(id_col, plain.alias("base"), scored(F.col("rest"), model, rules).alias("added"))
    ordered = F.transform(
        F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return rows.select(id_col, "base", ordered.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, model: SecretModel, mask: str = "[secret]", rules: SecretRules = SecretRules()) -> Column:
    """The text with every stretch covered by spans replaced by ``mask``; null stays null."""

    def clean(text: str) -> str:
        base = base_spans(text)
        spans = [s[1:3] for s in base] + [c[:2] for c in candidates(text, base, rules.min_length) if model.is_credential(c[2], rules)]
        if not spans:
            return text
        parts, at = [], 0
        for start, end in sorted(spans):
            if start >= at:
                parts += [text[at:start], mask]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    @F.arrow_udf(T.StringType())
    def hide(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else clean(t) for t in column.to_pylist()], pa.string())

    return hide(text)


def mask_secrets(
    docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: SecretRules = SecretRules()
) -> DataFrame:
    """The rows of ``docs`` with secrets masked; ``length_col`` (if there is such a column) follows the new text."""
    found = materialise(docs.select(scanned(F.col(text_col), rules).alias("f")).select("f.*"), "secret-candidates")
    model = learn(found, rules)
    clean = docs.select(F.struct("*").alias("row"), masked(F.col(text_col), model, rules=rules).alias("clean"))
    fields = []
    for name, kind in docs.dtypes:
        if name == text_col:
            fields.append(F.col("clean").alias(name))
        elif name == length_col:
            changed = ~F.col(f"row.{text_col}").eqNullSafe(F.col("clean"))
            fields.append(F.when(changed, F.char_length("clean").cast(kind)).otherwise(F.col(f"row.{name}")).alias(name))
        else:
            fields.append(F.col("row")[name].alias(name))
    return clean.select(*fields)
