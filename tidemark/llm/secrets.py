"""Secret scans: grammar inference over labelled credentials.

For each credential format a probabilistic automaton is inferred by merging the states of the prefix tree of its
labelled examples where their statistics are compatible (state merging in red-blue order with Hoeffding
bounds, after Carrasco and Oncina's ALERGIA; among several compatible states the one that gives the examples the
highest likelihood).  A background automaton is inferred likewise from long ordinary tokens of the corpus.  Every
candidate token of a text is scored: the log likelihood a character by the best format, and its ratio to the
background.  A candidate that reaches the format's own range and the ratio adds a span.  Candidates are whole runs of
credential characters; and their parts: from every separator to the end of the run or to
the next ``=`` or ``/``, and from every format's first characters to the end of that format's own characters.  Of the parts that
pass, those with the most evidence (nats above the background) are kept, without overlap.

Candidates have ``LEAST_RUN`` characters or more, among them a letter and a digit.

Labelled examples: credentials made by the published rules of some formats, and the values that the base patterns find in
the corpus: a sample of at most ``bound`` different ones of a kind, those of least hash among the values of at most ``longest`` characters.
Ordinary tokens are candidates and ASCII words of ``word`` characters or more, sampled likewise.  Scanning has no such bounds.

Base spans (kept in any case, leftmost and non-overlapping per kind): assign, access, hex; see BASE.  Added spans
have the kind ``fmt_`` and the format, and never overlap a base span.

Edge cases: null texts count as empty.  Without base values or ordinary tokens in the corpus the automata rest on the
published rules and on a uniform background.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_columns, materialise, prepare, read

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of [0-9a-f]+; the length is part of the pattern.
HEX_RUN = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Published credential formats, as (name, prefixes, alphabet, lengths of the parts, separator).
ALNUM = string.ascii_letters + string.digits
FORMATS = (
    ("access", ("AKIA",), string.ascii_uppercase + string.digits, (16,), ""),
    ("github", ("ghp_", "gho_", "ghs_"), ALNUM, (36,), ""),
    ("githubpat", ("github_pat_",), ALNUM, (22, 59), "_"),
    ("gitlab", ("glpat-",), ALNUM + "_-", (20,), ""),
    ("google", ("AIza",), ALNUM + "_-", (35,), ""),
    ("jwt", ("eyJ",), ALNUM + "_-", (33, 80, 43), "."),
    ("npm", ("npm_",), ALNUM, (36,), ""),
    ("sendgrid", ("SG.",), ALNUM + "_-", (22, 43), "."),
    ("slack", ("xoxb-", "xoxp-"), string.digits, (12, 12), "-"),
    ("stripe", ("sk_live_", "rk_live_"), ALNUM, (24,), ""),
)

#: Lengths of the parts that made examples have, where they aren't fixed: (least, most) of each part.
RANGES = {"gitlab": ((20, 50),), "jwt": ((17, 60), (20, 200), (43, 86)), "slack": ((10, 13), (10, 13)), "stripe": ((24, 99),)}

#: Candidates are whole runs of these characters; a run of hexadecimal digits is always inside of one.
LEAST_RUN = 16
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_RUN},}}")
#: A part begins after any separator or at a format's first characters, and ends with the run, before = or /, or with the format's own characters.
PART_START, PIECE = re.compile(r"(?<=[=/._-])[^=/._-]"), re.compile(rf"[^=/]{{{LEAST_RUN},}}")
OWN = {name: re.compile(f"(?:{'|'.join(map(re.escape, prefixes))})[{re.escape(alphabet + separator)}]*") for name, prefixes, alphabet, _, separator in FORMATS}
FIRST = {name: re.compile("|".join(map(re.escape, prefixes))) for name, prefixes, _, _, _ in FORMATS}
KEYWORDS = ("token", "secret", "passw", "apikey", "api_key")
#: Values of a kind that come to the driver for training, the longest of them, characters of an ordinary word at least; made examples of a format.
BOUND, LONGEST, LONG_WORD, EXAMPLES = 400, 200, 10, 150
#: Confidence of the compatibility test; nats a character by which a format must beat the background; slack below the examples' range.
ALPHA, RATIO, SLACK = 0.05, 0.6, 0.35

_CLASSES = [set(string.digits), set("abcdef"), set("ghijklmnopqrstuvwxyz"), set("ABCDEF"), set("GHIJKLMNOPQRSTUVWXYZ"), set("+/_.=-")]
_CLASS = {c: k for k, group in enumerate(_CLASSES) for c in group}
_SIZES = [len(g) for g in _CLASSES]
END = ""


class Automaton:
    """States are numbers; counts[s][c] examples leave s by c (END: stop there), to[s][c] is the next state."""

    def __init__(self):
        self.counts: list[dict[str, int]] = [defaultdict(int)]
        self.to: list[dict[str, int]] = [{}]

    @classmethod
    def infer(cls, examples: list[str], alpha: float = ALPHA) -> Automaton:
        self = cls()
        for word in sorted(examples):
            state = 0
            for c in word:
                self.counts[state][c] += 1
                if c not in self.to[state]:
                    self.to[state][c] = len(self.to)
                    self.to.append({})
                    self.counts.append(defaultdict(int))
                state = self.to[state][c]
            self.counts[state][END] += 1
        self._merge(alpha)
        self._compact()
        self._freeze()
        return self

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether the class frequencies of two states, and of all that follows them, differ by no more than chance."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            ca, cb = self.counts[a], self.counts[b]
            na, nb = sum(ca.values()), sum(cb.values())
            if not na or not nb:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (na**-0.5 + nb**-0.5)
            groups: dict = defaultdict(lambda: [0, 0])
            for c, n in ca.items():
                groups[_CLASS.get(c, c)][0] += n
            for c, n in cb.items():
                groups[_CLASS.get(c, c)][1] += n
            if any(abs(x / na - y / nb) > bound for x, y in groups.values()):
                return False
            # a character that one state takes always and the other hardly ever
            if any(abs(ca.get(c, 0) / na - cb.get(c, 0) / nb) > bound for c in ca.keys() | cb.keys()):
                return False
            pending += [(self.to[a][c], self.to[b][c]) for c in self.to[a].keys() & self.to[b].keys()]
        return True

    def _likelihood(self, red: int, blue: int) -> float:
        """Mean log likelihood of blue's suffixes (along its tree) under the classes' frequencies at and after red."""
        total, n, pending = 0.0, 0, [(red, blue)]
        while pending:
            a, b = pending.pop()
            ca = self.counts[a]
            size = sum(ca.values())
            by: dict = defaultdict(int)
            for c, k in ca.items():
                by[_CLASS.get(c, c)] += k
            for c, k in self.counts[b].items():
                total += k * math.log((by[_CLASS.get(c, c)] + 0.1) / (size + 0.7))
                n += k
                if c != END:
                    pending.append((self.to[a].get(c, a), self.to[b][c]))
        return total / max(n, 1)

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree at b to state a."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            for c, n in self.counts[b].items():
                self.counts[a][c] += n
                if c != END:
                    if c in self.to[a]:
                        pending.append((self.to[a][c], self.to[b][c]))
                    else:
                        self.to[a][c] = self.to[b][c]

    def _merge(self, alpha: float) -> None:
        red = [0]
        while True:
            settled = set(red)
            blue = sorted({(-sum(self.counts[t].values()), s, c) for s in red for c, t in self.to[s].items() if t not in settled})
            if not blue:
                return
            _, source, c = blue[0]
            state = self.to[source][c]
            alike = [r for r in red if self._compatible(r, state, alpha)]
            if alike:
                best = max(alike, key=lambda r: (self._likelihood(r, state), -r))
                self.to[source][c] = best
                self._fold(best, state)
            else:
                red.append(state)

    def _compact(self) -> None:
        """Drops the states that merging has left without a way from the start: nearly all of the tree, and every task holds the rest."""
        kept = [0]
        new = {0: 0}
        for s in kept:
            for t in self.to[s].values():
                if t not in new:
                    new[t] = len(kept)
                    kept.append(t)
        self.counts = [self.counts[s] for s in kept]
        self.to = [{c: new[t] for c, t in self.to[s].items()} for s in kept]

    def _freeze(self) -> None:
        """Log probabilities with the classes' frequencies and then all characters alike as back-off."""
        self.logs: list[dict[str, float]] = []
        self.rest: list[list[float]] = []
        self.stop: list[float] = []
        for counts in self.counts:
            n = sum(counts.values())
            by = [0.0] * len(_SIZES)
            for c, k in counts.items():
                if c != END:
                    by[_CLASS[c]] += k
            back = [(by[k] + 0.02) / (n + 0.02 * len(_SIZES) + 0.02) / _SIZES[k] for k in range(len(_SIZES))]
            weight = 2.0
            self.logs.append({c: math.log((k + weight * back[_CLASS[c]]) / (n + weight)) for c, k in counts.items() if c != END})
            self.rest.append([math.log(weight * back[k] / (n + weight)) for k in range(len(_SIZES))])
            self.stop.append(math.log((counts.get(END, 0) + 0.02) / (n + 1)))

    def score(self, word: str) -> float:
        """Log likelihood a character, the end included."""
        state, total = 0, 0.0
        for c in word:
            found = self.logs[state].get(c)
            total += self.rest[state][_CLASS[c]] if found is None else found
            state = self.to[state].get(c, state)
        return (total + self.stop[state]) / (len(word) + 1)

    def suffixes(self, word: str, starts: list[int]) -> list[float]:
        """score() of word[s:] for each start s. Paths that meet share what follows, so time is in proportion to the word."""
        known: dict[tuple[int, int], float] = {}
        out, n = [], len(word)
        for at in starts:
            state, i, path = 0, at, []
            while i < n and (i, state) not in known:
                c = word[i]
                found = self.logs[state].get(c)
                path.append((i, state, self.rest[state][_CLASS[c]] if found is None else found))
                state = self.to[state].get(c, state)
                i += 1
            total = self.stop[state] if i == n else known[i, state]
            for i, state, log in reversed(path):
                total += log
                known[i, state] = total
            out.append(total / (n - at + 1))
        return out


def made_examples(n: int = EXAMPLES) -> dict[str, list[str]]:
    """Labelled credentials by the published rules."""
    drawn = random.Random(3)
    made = {}
    for name, prefixes, alphabet, parts, separator in FORMATS:
        sizes = RANGES.get(name, tuple((k, k) for k in parts))
        body = lambda: separator.join("".join(drawn.choice(alphabet) for _ in range(drawn.randint(a, b))) for a, b in sizes)  # noqa: B023, E731
        made[name] = [prefixes[i % len(prefixes)] + body() for i in range(n)]
    return made


class Model:
    def __init__(self, formats: dict[str, list[str]], ordinary: list[str], like: Model | None = None):
        """like: a model whose automata of equal examples are taken over."""
        self.examples = formats
        same = {name for name, words in formats.items() if like and like.examples.get(name) == words}
        self.formats = {name: like.formats[name] if name in same else Automaton.infer(words) for name, words in sorted(formats.items()) if len(words) >= 20}
        self.background = Automaton.infer(ordinary) if len(ordinary) >= 20 else None
        self.floor, self.shortest = {}, {}
        for name, automaton in self.formats.items():
            own = sorted(automaton.score(w) for w in formats[name])
            self.floor[name] = own[len(own) // 50] - SLACK
            # The values of the corpus have lengths of their own; made examples say nothing of the least length.
            self.shortest[name] = sorted(map(len, formats[name]))[len(own) // 50] if name in BASE else 0

    def judge(self, word: str) -> str | None:
        """The format of a candidate, if it is one. The length of a published format is judged by its automaton alone."""
        best = max(((a.score(word), name) for name, a in self.formats.items() if len(word) >= self.shortest[name]), default=None)
        if best is None or best[0] < self.floor[best[1]]:
            return None
        if self.background and best[0] - self.background.score(word) < RATIO:
            return None
        return best[1]

    def _suffixes(self, word: str, starts: list[int], names) -> list[tuple[float, int, int, str]]:
        """(evidence, start, length, format) of the suffixes that are a credential."""
        scores = {name: self.formats[name].suffixes(word, starts) for name in names if name in self.formats}
        plain = self.background.suffixes(word, starts) if self.background else None
        found = []
        for k, at in enumerate(starts):
            size = len(word) - at
            best = max(((s[k], name) for name, s in scores.items() if size >= self.shortest[name]), default=None)
            if best is None or best[0] < self.floor[best[1]] or plain and best[0] - plain[k] < RATIO:
                continue
            found.append(((best[0] - (plain[k] if plain else self.floor[best[1]])) * (size + 1), at, size, best[1]))
        return found

    def parts(self, run: str) -> tuple[list[tuple], list[tuple]]:
        """(evidence, start, end, format) of the parts of a run that are credentials, best first; they can overlap.

        First those of a format's own characters, then others, which may have taken in what stands around.
        """
        found = []

        def judged(a: int, b: int, starts: list[int], names) -> None:
            word = run[a:b].rstrip(".=-")
            last = max((i for i, c in enumerate(word) if c.isdigit()), default=-1)
            letter = max((i for i, c in enumerate(word) if c.isalpha()), default=-1)
            starts = [s - a for s in starts if s - a <= min(last, letter) and len(word) - (s - a) >= LEAST_RUN]
            if starts:
                found.extend((e, a + s, a + s + size, name) for e, s, size, name in self._suffixes(word, starts, names))

        begins = [m.start() for m in PART_START.finditer(run)]
        judged(0, len(run), begins, self.formats)
        for m in PIECE.finditer(run):
            if m.end() < len(run):
                judged(m.start(), m.end(), [s for s in (m.start(), *(x.start() for x in PART_START.finditer(run, m.start() + 1, m.end())))], self.formats)
        others, found = found, []
        for name, own in OWN.items():
            at = 0
            while m := own.search(run, at):
                judged(m.start(), m.end(), [x.start() for x in FIRST[name].finditer(run, m.start(), m.end())], (name,))
                at = m.end()
        best = lambda p: (-p[0], p[1:])
        return sorted(found, key=best), sorted(others, key=best)


def base_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), by start and kind. runs: what RUN finds, if it is known."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):  # without one of them the pattern can't match
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append(("assign", m.start(), m.end(), m.start(2)))
    for run in RUN.finditer(text) if runs is None else runs:
        if "AKIA" in run[0]:
            found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text, run.start(), run.end()) if m.end() - m.start() >= LEAST["access"]]
        if run.end() - run.start() >= LEAST["hex"]:
            found += [("hex", m.start(), m.end(), m.start()) for m in HEX_RUN.finditer(text, run.start(), run.end())]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0]))) if len(found) > 1 else found


def candidates(runs: list[re.Match], taken: list[tuple]) -> list[tuple[int, int, str]]:
    """Runs with a letter and a digit that don't overlap the taken spans."""
    found = []
    for m in runs:
        word = m[0].rstrip(".=-") if m[0][-1] in ".-" else m[0]
        if len(word) < LEAST_RUN or word[0] == "." or word.isalpha() or not any(map(str.isdigit, word)) or not any(map(str.isalpha, word)):
            continue
        start, end = m.start(), m.start() + len(word)
        if not any(s[1] < end and start < s[2] for s in taken):
            found.append((start, end, word))
    return found


def scan(text: str | None, model: Model) -> tuple[list[tuple], list[tuple]]:
    """Base spans and added spans of a text."""
    runs = list(RUN.finditer(text or ""))
    base = base_spans(text or "", runs)
    added = []
    whole = {start: [(0.0, 0, end - start, name)] for start, end, word in candidates(runs, base) if (name := model.judge(word))}
    for m in runs:
        if not any(map(str.isdigit, m[0])):
            continue
        taken = [(s[1], s[2]) for s in base if s[1] < m.end() and m.start() < s[2]]
        own, others = model.parts(m[0])
        for _, a, b, name in own + whole.get(m.start(), []) + others:
            start, end = m.start() + a, m.start() + b
            if not any(s < end and start < e for s, e in taken):
                taken.append((start, end))
                added.append((f"fmt_{name}", start, end, start))
    return base, sorted(added, key=lambda s: s[1])


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def all_spans(base: list[tuple], added: list[tuple]) -> list[tuple]:
    """By start, then base kinds as listed, then formats."""
    return sorted(base + added, key=lambda s: (s[1], BASE.index(s[0]) if s[0] in BASE else len(BASE), s[0]))


def train(df: DataFrame, bound: int = BOUND, longest: int = LONGEST, word: int = LONG_WORD, text_col: str = "text") -> Model:
    """Infers the automata from a sample: at most bound values a kind (and bound ordinary tokens, bound words) come to the driver.

    They are those of least hash among all of the corpus with at most longest characters.  One pass over the texts: every batch keeps
    its least values of each kind, among which the least of all are.
    """
    prepare(df.sparkSession)

    def make():
        def work(texts):
            found: dict[str, set[tuple[int, str]]] = defaultdict(set)
            limit: dict[str, int] = defaultdict(lambda: 1 << 64)  # what can't be among the least any more

            def add(kind: str, values) -> None:
                some, top = found[kind], limit[kind]
                some.update(x for w in values if len(w) <= longest and (x := (hash_of(w), w))[0] < top)
                if len(some) > 8 * bound:
                    found[kind] = set(sorted(some)[:bound])
                    limit[kind] = max(found[kind])[0] + 1

            for text in texts:
                runs = list(RUN.finditer(text or ""))
                base = base_spans(text or "", runs)
                for kind, _, end, at in base:
                    add(kind, [text[at:end]])
                add("ordinary", [w for _, _, w in candidates(runs, base)])
                # long words stand for ordinary tokens where tokens with digits are rare
                add("word", {w for w in (text or "").split() if len(w) >= word and w.isascii() and w.isalnum()})
            rows = [(kind, value, str(digest)) for kind, some in found.items() for digest, value in sorted(some)[:bound]]
            return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [])

        return work

    found = materialise(map_columns(df, [text_col], "kind string, word string, digest string", make).distinct())
    by: dict[str, list[str]] = defaultdict(list)
    for kind in (*BASE, "ordinary", "word"):
        some = found.filter(F.col("kind") == kind).orderBy(F.col("digest").cast("decimal(20,0)"), "word").limit(bound)
        by[kind] = [r["word"] for r in some.select("word").collect()]
    formats = made_examples()
    formats["access"] += [w for w in by["access"] if set(w) <= _CLASS.keys()]
    formats["hex"] = by["hex"]
    formats["assign"] = by["assign"]
    # an ordinary token that a published format explains isn't evidence for the background
    shapes = Model({k: v for k, v in formats.items() if k not in ("hex", "assign")}, [])
    ordinary = [w for w in by["ordinary"] if shapes.judge(w) is None] + by["word"]
    return Model({k: [w for w in v if set(w) <= _CLASS.keys()] for k, v in formats.items()}, [w for w in ordinary if set(w) <= _CLASS.keys()], shapes)


def hash_of(word: str) -> int:
    return xxh64_intdigest(word.encode())


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, base and added (arrays of kind, start, end), redacted (the text with the secrets replaced)."""

    def make():
        def work(keys, texts):
            told = [scan(t, model) for t in texts]
            form = lambda spans: [{"kind": s[0], "start": s[1], "end": s[2]} for s in spans]
            return keys, [form(b) for b, _ in told], [form(a) for _, a in told], [None if t is None else redact(t, b + a) for t, (b, a) in zip(texts, told, strict=True)]

        return work

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_columns(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, base {span}, added {span}, redacted string", make)


def redact(text: str, spans: list[tuple], mark: str = "[SECRET]") -> str:
    """The secrets themselves replaced, overlapping ones together."""
    out, at = [], 0
    end = -1
    for start, stop in sorted((s[3], s[2]) for s in spans):
        if start > end or end < 0:
            if end >= 0:
                at = end
            out += [text[at:start], mark]
            end = stop
        end = max(end, stop)
        at = end
    out.append(text[at:])
    return "".join(out)


def redacted_rows(df: DataFrame, model: Model, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """df's rows and columns with every secret of the text replaced; count_col, if df has it, follows a changed text."""
    import pyarrow as pa

    prepare(df.sparkSession)
    names = df.columns

    def run(batches):
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            texts = columns[text_col].to_pylist()
            found = {i: base + added for i, t in enumerate(texts) if t for base, added in (scan(t, model),) if base or added}
            if found:
                for i, spans in found.items():
                    texts[i] = redact(texts[i], spans)
                columns[text_col] = pa.array(texts, columns[text_col].type)
                if count_col in columns:
                    sizes = columns[count_col].to_pylist()
                    for i in found:
                        sizes[i] = len(texts[i])
                    columns[count_col] = pa.array(sizes, columns[count_col].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return df.mapInArrow(run, df.schema)


def digests(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_assign, n_access, n_hex, base_sha256, spans, n_added."""

    def make():
        def work(keys, texts):
            rows = []
            for t in texts:
                base, added = scan(t, model)
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(base, added)), len(added)))
            return keys, *map(list, zip(*rows, strict=True))

        return work

    return map_columns(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long", make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return digests(docs, train(docs))
