"""Secret scans: base patterns, and a character convolutional network over every candidate.

Base spans come from three fixed patterns, leftmost and non-overlapping for each kind.
Candidates are these and, in what they leave of a text, every run of LEAST or more characters of
keys and tokens. The network sees a whole candidate with the characters around it:
embedding, convolution, maximum over places, a hidden layer. Of a run longer than SPAN
characters every part between separators is a candidate, and every window of SPAN characters, half of it
overlapping the next, so that a key in the middle of a path or a URL is seen too; an accepted window gives way to
the best part that it meets. Accepted candidates that touch are joined and added as kind `cnn`. Base spans are scored like the others but always
stay; those below the threshold of their kind (look-alikes, such as a commit's digest) are counted as n_doubted.

The network is written in numpy and trained here, on findings labelled by how they are made:
random keys of many formats in assignments, headers and URLs, against identifiers, digests,
placeholders, paths, words and numbers in like places, for each kind. Three parts of the findings never meet: the
first fits the network, the second calibrates its scores (Platt scaling), and on the third each kind gets the largest
threshold that keeps RECALL of its secrets.

Spans are code points, end exclusive. Nulls and odd input: a null text is empty and has
no spans, and an empty table gives no rows. Texts and candidates of any length are searched as a whole. Repeated rows
give equal results. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import bounded_batches

KINDS = ("assign", "access", "hex", "cnn")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed patterns; letters of the key words in either case.
ASSIGN = re.compile(
    "(" + "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
PART = re.compile(r"[^/.=~]{16,}")

BEFORE, SPAN, AFTER = 28, 64, 8
LENGTH = BEFORE + SPAN + AFTER + 2
EMBED, FILTERS, WIDTH, HIDDEN = 12, 32, 5, 24
RECALL = 0.95
EPOCHS, EXAMPLES, SEED = 5, 14_400, 11
#: Windows scored at a time.
SCORED = 4096
#: Letters, digits and signs one by one, then other ASCII, other letters, borders and padding.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/=.:'\"@ \n,;(){}[]<>#&?$%!*~\\|"
_CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
_OTHER, _LETTER, _OPEN, _CLOSE = len(ALPHABET) + 1, len(ALPHABET) + 2, len(ALPHABET) + 3, len(ALPHABET) + 4
VOCABULARY = len(ALPHABET) + 5


def window(text: str, start: int, end: int) -> list[int]:
    """Codes of a candidate (its first SPAN characters; longer ones come as several) and its surroundings, borders marked, of fixed length."""

    def codes(s: str) -> list[int]:
        return [_CODE.get(c) or (_LETTER if c.isalpha() else _OTHER) for c in s]

    before = codes(text[max(0, start - BEFORE) : start])
    out = [0] * (BEFORE - len(before)) + before + [_OPEN] + codes(text[start : min(end, start + SPAN)]) + [_CLOSE] + codes(text[end : end + AFTER])
    return out + [0] * (LENGTH - len(out))


class Network:
    """Embedding, one convolution, maximum over places, one hidden layer, one score."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = {
            "e": rng.normal(0, 0.3, (VOCABULARY, EMBED)),
            "c": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
            "cb": np.zeros(FILTERS),
            "h": rng.normal(0, (2 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)),
            "hb": np.zeros(HIDDEN),
            "o": rng.normal(0, HIDDEN**-0.5, HIDDEN),
            "ob": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.scale, self.shift, self.thresholds = 1.0, 0.0, np.full(len(KINDS), 0.5)

    def _forward(self, x: np.ndarray) -> tuple:
        w = self.w
        e = w["e"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(x.shape[0], -1, WIDTH * EMBED)
        a = cols @ w["c"] + w["cb"]
        r = np.maximum(a, 0)
        # the candidate's own places and the places before it are pooled apart
        split = BEFORE + 1
        at1, at2 = r[:, :split].argmax(1), r[:, split:].argmax(1) + split
        pooled = np.concatenate([np.take_along_axis(r, at1[:, None], 1)[:, 0], np.take_along_axis(r, at2[:, None], 1)[:, 0]], axis=1)
        h = np.maximum(pooled @ w["h"] + w["hb"], 0)
        return cols, a, at1, at2, pooled, h, h @ w["o"] + w["ob"]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[-1]

    def probability(self, windows: np.ndarray) -> np.ndarray:
        out = [self.scores(windows[i : i + 256]) for i in range(0, len(windows), 256)]
        z = np.concatenate(out) if out else np.empty(0)
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        cols, a, at1, at2, pooled, h, z = self._forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) / y.size
        g = {"o": h.T @ dz, "ob": dz.sum(keepdims=True)}
        dh = np.outer(dz, w["o"]) * (h > 0)
        g["h"], g["hb"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ w["h"].T
        da = np.zeros_like(a)
        n, f = np.arange(x.shape[0])[:, None], np.arange(FILTERS)[None, :]
        for at, d in ((at1, dp[:, :FILTERS]), (at2, dp[:, FILTERS:])):
            da[n, at, f] += d * (a[n, at, f] > 0)
        g["c"], g["cb"] = np.tensordot(cols, da, axes=((0, 1), (0, 1))), da.sum((0, 1))
        dcols = (da @ w["c"].T).reshape(x.shape[0], -1, WIDTH, EMBED)
        de = np.zeros((*x.shape, EMBED), np.float32)
        for k in range(WIDTH):
            de[:, k : k + dcols.shape[1]] += dcols[:, :, k]
        g["e"] = np.zeros_like(w["e"])
        np.add.at(g["e"], x, de)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam over shuffled batches."""
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = rng.permutation(y.size)
            for i in range(0, y.size, 128):
                step += 1
                for k, d in self.gradients(x[order[i : i + 128]], y[order[i : i + 128]]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                    self.w[k] -= 0.006 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps."""
        z, t = self.scores(x), np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (y.size - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * z + b)))
            s = p * (1 - p) + 1e-9
            hessian = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
            da, db = np.linalg.solve(hessian, [((p - t) * z).sum(), (p - t).sum()])
            a, b = a - da, b - db
        self.scale, self.shift = a, b

    def constrain(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray, recall: float = RECALL) -> None:
        """For each kind the largest threshold that keeps the recall among its findings."""
        p = self.probability(x)
        for k in range(len(KINDS)):
            found = np.sort(p[(y > 0) & (kinds == k)])
            self.thresholds[k] = found[int(np.floor((1 - recall) * found.size))]


def labelled_findings(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and kinds of made findings, half of them secrets."""
    rng = np.random.default_rng(seed)
    lower, upper, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    alnum = lower + upper + digits
    syllables = "th er on an re he in ed nd ha at en es of or ti ou ble tion sch keit ung eau oi ment ado cion que ies ing ly st ea ch ver ein".split()

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def some(chars: str, low: int, high: int | None = None) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), int(rng.integers(low, (high or low) + 1))))

    def word(low: int = 1, high: int = 4) -> str:
        return "".join(pick(syllables) for _ in range(int(rng.integers(low, high + 1))))

    def prose() -> str:
        return " ".join(word() for _ in range(int(rng.integers(2, 7)))) + pick(["", ".", ",", ":", "\n"])

    def mixed(low: int, high: int | None = None, chars: str = alnum) -> str:
        while True:
            s = some(chars, low, high)
            if re.search("[0-9]", s) and re.search("[A-Za-z]", s):
                return s

    def camel() -> str:
        return word(1, 2) + "".join(word(1, 2).capitalize() for _ in range(int(rng.integers(2, 5))))

    def long_word() -> str:
        return pick([str, str.capitalize, str.upper])(word(6, 12)) + pick(["", "", ".", "..."])

    def value() -> str:
        """A random key in one of many formats."""
        return pick([
            lambda: mixed(20, 48), lambda: "ghp_" + mixed(36), lambda: "sk_live_" + mixed(24), lambda: "xoxb-" + some(digits, 11, 12) + "-" + mixed(24), lambda: "eyJ" + mixed(14, 40) + "." + mixed(18, 60) + "." + mixed(20, 43),
            lambda: mixed(32, 64, hexes), lambda: mixed(40, 40, alnum + "+/"), lambda: "AIza" + mixed(35), lambda: mixed(22, 43, alnum + "-_"), lambda: some(lower + upper, 24, 40), lambda: mixed(26, 32, upper + "234567"), lambda: mixed(43, 43, alnum + "+/") + "=",
        ])()

    def dull() -> str:
        """A run that is as long, but no key."""
        return pick([
            long_word, long_word, long_word, lambda: word(6, 12), lambda: some(digits, 16), lambda: "/".join(word() for _ in range(int(rng.integers(4, 9)))) + some(digits, 0, 3), lambda: "_".join(word() for _ in range(int(rng.integers(4, 7)))) + some(digits, 0, 4), camel, lambda: camel() + some(digits, 1, 3),
            lambda: "-".join(word() for _ in range(int(rng.integers(4, 8)))), lambda: "www." + word(2, 3) + ".example.com/" + word(2, 4) + some(digits, 1, 4), lambda: "mail" + some(digits, 1) + "." + word(1, 3) + ".example.com", lambda: word(2, 4) + "." + word(2, 3) + "-" + some(digits, 1) + "." + some(digits, 1) + ".tar.gz",
            lambda: "20" + some(digits, 2) + "-0" + some("123456789", 1) + "-1" + some(digits, 1) + "T10-" + some("012345", 1) + some(digits, 1) + "-30.1", lambda: some(digits, 16, 20), lambda: some(digits, 12, 20) + pick(["px", "kg", "ms"]), lambda: pick("-=._~+") * int(rng.integers(16, 60)),
            lambda: "-".join([some(hexes, 8), some(hexes, 4), some(hexes, 4), some(hexes, 4), some(hexes, 12)]), lambda: "-".join(some(digits, 3, 5) for _ in range(4)), lambda: pick(["X", "x", "0", "A"]) * int(rng.integers(16, 40)), lambda: "1234567890abcdef" * int(rng.integers(1, 3)),
            lambda: "YOUR" + pick("_-") + word(2).upper() + pick("_-") + pick(["KEY", "TOKEN"]) + pick("_-") + "HERE", lambda: "data/" + word(2) + "/part-000" + some(digits, 2) + "." + word(1) + ".parquet", lambda: "ISBN-978-" + some(digits, 1) + "-" + some(digits, 4) + "-" + some(digits, 4),
        ])()

    held = [
        ("Authorization: Bearer ", "\n"), ("key=", "&"), ("client_key: ", "\n"), ("auth = '", "'"), ('credential: "', '"'), ("private_key=", " "), ("access=", "\n"), ("https://user:", "@"), ("export KEY=", "\n"), ("pw: ", " "), ("signature=", "&"), (" ", " "), ("/webhook/", "/"), ("sig/", "\n"), ("/", "/"), ("/", " "), ("=", "/"),
    ]
    plain = [(" ", " "), (" ", ", "), ("see ", " "), ("(", ")"), ("http://", " "), ("path: ", "\n"), ("id: ", " "), ("class=", " "), ("call ", "("), ("\n", "\n"), ("/", "/"), ("@", " "), ("def ", ":"), ("file=", "&")]
    sums = [("commit ", "\n"), ("sha1 ", "\n"), ("sha256:", " "), ("md5: ", "\n"), ("tree ", "\n"), ("revision ", " "), ("checksum ", " "), ("etag: ", "\n"), ("index ", "..")]

    def cnn(secret: bool) -> tuple[str, str, str]:
        v = value() if secret else dull()
        before, after = pick(held) if secret else pick(plain + held[-5:] + held[1:2])
        if not secret and rng.random() < 0.15:  # digests are like keys, but said to be digests
            v, (before, after) = some(hexes, 40), pick(sums)
        return before, v if len(v) >= LEAST else v + "-" + word(6, 9), after

    def assign(secret: bool) -> tuple[str, str, str]:
        key = pick(["password", "passwd", "secret", "token", "api_key", "apikey", "PASSWORD", "Token"])
        if secret:
            v = pick([value, lambda: mixed(8, 16), lambda: word(2) + some(digits, 2, 4), lambda: word(1, 2).capitalize() + some(digits, 1, 4) + pick("_-=.")])()
        else:
            v = pick([camel, dull, lambda: "os.environ.get", lambda: "getpass.getpass", lambda: word(3, 5), lambda: "string", lambda: "required", lambda: "undefined", lambda: "config." + word(2) + "_" + key.lower(), lambda: "x" * int(rng.integers(6, 20)), lambda: "your_" + key.lower(), lambda: "changeme"])()
        v = re.sub("[^A-Za-z0-9+/_.=-]", "", v)
        sign, quote = pick([": ", "=", " = ", ":"]), pick(["", "'", '"'])
        return pick(["", " ", "\n", "my_"]), f"{key}{sign}{quote}{v if len(v) >= 6 else v + 'string'}", quote or pick(["\n", " ", ";"])

    def access(secret: bool) -> tuple[str, str, str]:
        v = some(upper + digits, 16) if secret else pick([lambda: "EXAMPLE" * 3, lambda: pick("X0A1") * 16, lambda: word(8, 12).upper().ljust(16, "E"), lambda: some(digits, 16, 30), lambda: "1234567890" * 2])()
        return pick(held)[0] if rng.random() < 0.7 else " ", "AKIA" + v, pick([" ", "\n", '"', ","])

    def hexed(secret: bool) -> tuple[str, str, str]:
        if secret:
            return pick(held)[0], some(hexes, 24, 64), pick([" ", "\n", '"', "&"])
        v = pick([lambda: some(hexes, 40), lambda: some(hexes, 64), lambda: some(digits, 24, 30), lambda: pick(hexes) * int(rng.integers(24, 50)), lambda: "0123456789abcdef" * 2, lambda: "deadbeef" * 4])()
        return (*pick(sums)[:1], v, pick(["\n", " "]))

    windows, labels, kinds = [], [], []
    for i in range(n):
        kind, secret = (3, 0, 3, 1, 3, 2)[i // 2 % 6], i % 2
        before, v, after = (assign, access, hexed, cnn)[kind](bool(secret))
        before = prose() + " " + before
        start = len(before)
        if kind == 3 and len(v) > SPAN:  # as a window on a longer run
            start += int(rng.integers(len(v) - SPAN + 1))
        windows.append(window(before + v + after + prose(), start, min(len(before) + len(v), start + SPAN)))
        labels.append(secret)
        kinds.append(kind)
    return np.array(windows), np.array(labels, np.float32), np.array(kinds)


_TRAINED: list[Network] = []


def trained() -> Network:
    """The network, trained once in a process: of twelve findings eight fit it, two calibrate it and two set its thresholds."""
    if not _TRAINED:
        x, y, kinds = labelled_findings()
        fit, scale = 8 * y.size // 12, 10 * y.size // 12
        net = Network()
        net.fit(x[:fit], y[:fit])
        net.calibrate(x[fit:scale], y[fit:scale])
        net.constrain(x[scale:], y[scale:], kinds[scale:])
        _TRAINED.append(net)
    return _TRAINED[0]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(x in low for x in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def left(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans (in order) leave of the runs of at least LEAST characters, in pieces of at least that, in order."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][0] < end:
            s, _, e = base[k]
            if e > end:  # it may reach into the next run
                break
            if s - at >= LEAST:
                out.append((at, s))
            at, k = max(at, e), k + 1
        if k < len(base) and base[k][0] < end:
            end = max(at, base[k][0])
        if end - at >= LEAST:
            out.append((at, end))
    return out


def candidates(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A run, or the parts and windows of a longer one."""
    if end - start <= SPAN:
        return [(start, end)]
    parts = [m.span() for m in PART.finditer(text, start, end) if m.end() - m.start() < end - start]
    windows = [(s, min(s + SPAN, end)) for s in range(start, end - SPAN // 2, SPAN // 2)]
    return sorted({*windows, *(p for p in parts if p[1] - p[0] <= SPAN)})


def merged(scored: list[tuple[int, int, float, bool]]) -> list[tuple[int, int]]:
    """Accepted of (start, end, score, accepted) as spans. A window gives way to the best part that it meets; what overlaps, touches or has one separator between is one."""
    parts = sorted(x for x in scored if x[1] - x[0] < SPAN)
    starts, taken = [x[0] for x in parts], []
    for s, e, _, accepted in scored:
        if accepted and e - s >= SPAN:
            inside = [x for x in parts[bisect_left(starts, s - SPAN) : bisect_left(starts, e)] if x[1] > s]
            s, e = max(inside, key=lambda x: x[2])[:2] if inside else (s, e)
        if accepted:
            taken.append((s, e))
    out: list[tuple[int, int]] = []
    for s, e in sorted(taken):
        if out and s <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(texts: list[str], net: Network) -> list[tuple[list, list, int]]:
    """(base spans, cnn spans, number of base spans that the network doubts) of each text."""
    base = [base_spans(x) for x in texts]
    doubted, found = [0] * len(texts), [[] for _ in texts]
    asked: list[tuple[int, int, int, int]] = []

    def answer() -> None:
        p = net.probability(np.array([window(texts[i], s, e) for i, _, s, e in asked]))
        for (i, k, s, e), score, accepted in zip(asked, p.tolist(), (p >= net.thresholds[[x[1] for x in asked]]).tolist(), strict=True):
            if k < 3:
                doubted[i] += not accepted
            else:
                found[i].append((s, e, score, accepted))
        asked.clear()

    for i, text in enumerate(texts):
        # every base span by its first window, so that it is counted once
        asked += [(i, k, s, e) for s, k, e in base[i]]
        for run in left(text, base[i]):
            asked += [(i, 3, s, e) for s, e in candidates(text, *run)]
            if len(asked) >= SCORED:
                answer()
    if asked:
        answer()
    return [(b, [(s, 3, e) for s, e in merged(f)], d) for b, f, d in zip(base, found, doubted, strict=True)]


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document; nothing is shuffled."""
    net = trained()
    bounded_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan([x or "" for x in b.column("text").to_pylist()], net)
            counts = [[sum(x[1] == k for x in base) for base, _, _ in found] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts]]
                + [pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _, _ in found]), pa.array([joined(sorted(base + more)) for base, more, _ in found])]
                + [pa.array([len(more) for _, more, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn", "n_doubted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(task, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, n_doubted long")
