"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags each token as beginning a secret (B), inside one (I) or outside (O). A token is seen as
its symbol: a lexicon word as itself, a name that holds a stem like ``key`` by that, any other token by its shape (length
class, character classes, how often letters and digits take turns). The score
of a tag is a sum of weights for the token's symbol, those of two tokens before and one after, and file
features (how long the text is, how many digits and equals signs it has), plus a weight for each pair of
neighbouring tags. It is fitted by maximum likelihood on a bounded sample of documents, labelled by the
fixed patterns and, weakly, by cue words and shapes that these do not know, and on made-up lines that pair
secrets and harmless values with many cue words; so it learns what the fixed patterns cannot tell. It is
decoded by Viterbi. Decoding is exact but skips tokens that cannot be anything but
O: those whose O weight leads by more than all that neighbouring tags can add.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import row_key
from cuelake.session import cut, read_table, ship

# Fixed patterns of the three base kinds, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
MASK = "[secret]"

#: At most so many documents with base matches, with weak ones only and with none are fitted on,
SAMPLE = 200
#: with so many windows of each, of so many tokens around a match.
WINDOWS, REACH = 4, 16
#: and on so many made-up lines.
MADE_UP = 4_000
LEXICON = 400
#: Characters up to which a token may be a lexicon word or a name.
SHORT_TOKEN = 24
#: Equals signs belong to a token only at its end, as padding.
TOKEN = re.compile(r"[\w+/.-]+(?:={1,2}(?![\w+/.=-]))?|[^\s\w]")
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: For the sample only: what holds every text with a base match, before the patterns themselves are tried.
_MAYBE = r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{32}"
OWN, BEFORE, BEFORE2, AFTER = range(4)
O, B, I = range(3)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # Runs of 32 or more are just the maximal runs that are long enough.
    found += [(*m.span(), "hex") for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_places(text: str) -> list[tuple[int, int]]:
    """Where the secret values themselves are: labels for fitting."""
    places = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    places += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return places + [m.span() for m in _HEX_RUN.finditer(text)]


#: Words that announce a secret although no base pattern knows them, for weak labels and made-up lines.
CUES = ("pwd", "passphrase", "passcode", "credential", "credentials", "auth", "authorization", "bearer", "private_key", "access_key", "signing_key", "encryption_key", "client_key", "license_key", "webhook", "pin", "login")
_VALUE = r"""(?=[^\s"']*[0-9])(?=[^\s"']*[A-Za-z])[A-Za-z0-9+/_.=-]{8,}"""
WEAK = re.compile(rf"""(?i)\b(?:{"|".join(c.replace("_", "[_ -]?") for c in CUES)})["']?\x20*(?:[:=]\x20*|\x20)["']?({_VALUE})""")
#: Shapes that services give their tokens.
ISSUED = re.compile(r"\b(?:ghp|gho|glpat|xox[abp]|sk|pk|rk)[-_][A-Za-z0-9_-]{12,}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|\bAIza[A-Za-z0-9_-]{12,}")


def weak_places(text: str) -> list[tuple[int, int]]:
    """Where cue words and shapes make a secret likely."""
    return [m.span(1) for m in WEAK.finditer(text)] + [m.span() for m in ISSUED.finditer(text)]


#: Parts of names that announce secrets: what an unlisted name is seen as if it holds one.
STEMS = ("passw", "pass", "pwd", "secret", "token", "cred", "auth", "key", "login", "lock", "pin")
#: A token too long for the lexicon goes into fitting as this mark and its shape, so that none is cut.
_SHAPED = "\x00"
_SWITCH = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


def stem(token: str) -> str | None:
    """The symbol of a name that is a word of letters, joined by _ . or -, with a stem in it."""
    low = token.lower()
    found = next((x for x in STEMS if x in low), None)
    return f"s{found}" if found and not any(c.isdigit() for c in low) and "=" not in low and "/" not in low else None


def shape(token: str) -> str:
    if len(token) > 1 and token[0] == _SHAPED:
        return token[1:]
    size = min(len(token).bit_length(), 7)
    if token.isalpha():
        case = "l" if token.islower() else "U" if token.isupper() else "T" if token[1:].islower() else "m"
        return f"{size}{case}"
    if len(token) == 1:
        return token if not token.isalnum() and token.isascii() else "1d" if token.isdigit() else "?"
    if token.isdigit():
        return f"{size}d"
    if not token.isascii():
        return f"{size}?"
    classes = "".join(
        c for c, p in (("d", r"[0-9]"), ("x", r"[a-f]"), ("l", r"[g-z]"), ("U", r"[A-Z]"), ("s", r"[+/_=-]"), (".", r"\.")) if re.search(p, token)
    )
    # How often letters and digits take turns: a made-up name has a number at its end, a key has them all over.
    turns = min(len(_SWITCH.findall(token)), 4)
    return f"{size}:{classes}{turns}"


def file_features(text: str) -> tuple[int, int, int]:
    """Numbers below 8, below 4 and below 4: size of the text, equals signs, share of digits."""
    equals = text.count("=")
    digits = sum(map(text.count, "0123456789"))
    return min(len(text).bit_length() // 3, 7), min(equals, 3), min(int(64 * digits / (len(text) + 1)), 3)


class Field:
    """Weights of a fitted field."""

    def __init__(self, symbols: dict[str, int], weights: np.ndarray, files: np.ndarray, trans: np.ndarray):
        self.symbols, self.weights, self.files, self.trans = symbols, weights, files, trans
        # What a tag other than O can gain through its two neighbours over O, at most.
        gain = [trans[a, y] + trans[y, b] - trans[a, O] - trans[O, b] for a in range(3) for b in range(3) for y in (B, I)]
        self.margin = float(max(gain)) + 1e-6

    def emissions(self, ids: np.ndarray, text_features: tuple[int, int, int]) -> np.ndarray:
        w = self.weights
        e = w[OWN][ids] + sum(self.files[i][f] for i, f in enumerate(text_features))
        e[1:] += w[BEFORE][ids[:-1]]
        e[2:] += w[BEFORE2][ids[:-2]]
        e[:-1] += w[AFTER][ids[1:]]
        return e

    def tags(self, ids: np.ndarray, text_features: tuple[int, int, int]) -> np.ndarray:
        """The best tags (Viterbi); a text is entered and left as from O."""
        e = self.emissions(ids, text_features)
        best = np.zeros(len(ids), dtype=np.int8)
        open_ = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.margin)
        if not len(open_):
            return best
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            score, back = self.trans[O] + e[part[0]], []
            for t in part[1:]:
                step = score[:, None] + self.trans
                back.append(step.argmax(axis=0))
                score = step.max(axis=0) + e[t]
            y = int((score + self.trans[:, O]).argmax())
            for t, b in zip(part[:0:-1], reversed(back)):
                best[t], y = y, int(b[y])
            best[part[0]] = y
        return best


class _Symbols(dict):
    """token -> symbol id, remembered."""

    def __init__(self, symbols: dict[str, int]):
        super().__init__()
        self.symbols = symbols

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        known = self.symbols.get("w" + token.lower()) if len(token) <= SHORT_TOKEN else None
        if known is None and len(token) <= SHORT_TOKEN and (s := stem(token)):
            known = self.symbols.get(s)
        got = known if known is not None else self.symbols.get(shape(token), 0)
        if len(token) <= 64:
            self[token] = got
        return got


def crf_spans(text: str, field: Field, ids_of: _Symbols) -> list[tuple[int, int]]:
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    ids = np.fromiter(map(ids_of.__getitem__, tokens), dtype=np.int32, count=len(tokens))
    tags = field.tags(ids, file_features(text))
    if not tags.any():
        return []
    spans: list[tuple[int, int]] = []
    last = O
    for m, y in zip(TOKEN.finditer(text), tags):
        if y == B or y == I and last == O:
            spans.append(m.span())
        elif y == I:
            spans[-1] = (spans[-1][0], m.end())
        last = y
    return spans


def find_secrets(text: str | None, field: Field | None, ids_of: _Symbols | None) -> tuple[list, list]:
    """Base spans; all spans, with those of the field that no base span overlaps. A span of the field that touches a base
    span in part is left out whole; spans of two kinds that begin at one place are in the order of KINDS."""
    text = text or ""
    base = base_spans(text)
    if field is None:
        return base, base
    more, reach, k = [], 0, 0  # reach: where the base spans that begin before a span's end have ended
    for s, e in crf_spans(text, field, ids_of):
        while k < len(base) and base[k][0] < e:
            reach, k = max(reach, base[k][1]), k + 1
        if reach <= s:
            more.append((s, e, "crf"))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


# --- fitting


Window = tuple[list[str], list[int], list[int]]


def windows_of(text: str, places: list[tuple[int, int]]) -> Iterator[Window]:
    """(tokens, tags, file features) around the first places of a text, or spread over it if there are none."""
    found = list(TOKEN.finditer(text))
    tag = np.zeros(len(found), dtype=np.int8)
    starts = [m.start() for m in found]
    for s, e in sorted(places):
        at = max(int(np.searchsorted(starts, s, side="right")) - 1, 0)
        upto = int(np.searchsorted(starts, e))
        inside = [k for k in range(at, upto) if found[k].end() > s]
        for k in inside:
            tag[k] = tag[k] or (I if k > inside[0] else B)
    marked = np.flatnonzero(tag == B)[:WINDOWS]
    centres = marked if len(marked) else np.linspace(0, max(len(found) - 1, 0), WINDOWS // 2, dtype=int) if found else []
    for c in centres:
        part = slice(max(0, c - REACH), c + REACH)
        tokens = [m[0] if len(m[0]) <= SHORT_TOKEN else _SHAPED + shape(m[0]) for m in found[part]]
        yield tokens, tag[part].tolist(), list(file_features(text))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[Window] = []
    for b in batches:
        for text in b.column(0).to_pylist():
            rows += windows_of(text or "", secret_places(text or "") + weak_places(text or ""))
    columns = [pa.array([r[k] for r in rows], pa.list_(t)) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
    yield pa.RecordBatch.from_arrays(columns, names=["tokens", "tags", "files"])


#: How a name and its value are joined in made-up lines: the same for secrets and for harmless values.
JOINTS = (" = ", "=", ": ", " : ", " ", " ", '="', "='", ': "', " := ", " -> ", '" : "')


def made_up(n: int, seed: int = 41) -> list[Window]:
    """Lines with a name and a secret, with a name and a harmless value, with a cue word in prose, and prose with
    numbers. Names are cue words, made of a stem and another word, or any word at all, and names, joints and quotes are drawn
    alike for secrets and harmless values, so that the value itself must tell them apart. File features are
    drawn at random, so that nothing is learned from them here."""
    rnd, rows = random.Random(seed), []
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = ("0123456789abcdef", small + large + digits, small + digits, large + digits, small + large + digits + "+/_-")
    cues = (*CUES, "password", "passwd", "secret", "token", "api_key", "apikey")
    plain = ("name", "version", "date", "id", "size", "url", "host", "page", "count", "color", "title", "user", "port", "path", "price", "chapter")
    pick = lambda letters, lo, hi: "".join(rnd.choice(letters) for _ in range(rnd.randrange(lo, hi)))
    word = lambda: pick("aeioulnrstdmkpbghcfvwy", 2, 11)
    number = lambda: pick(digits, 1, 18)

    def secret() -> str:
        alphabet, n = rnd.choice(alphabets), rnd.choice([8, 10, 12, 16, 20, 24, 31, 32, 40, 64])
        while True:
            value = "".join(rnd.choice(alphabet) for _ in range(n))
            if any(c in digits for c in value) and any(c.isalpha() for c in value) and value[0].isalnum() and value[-1].isalnum():
                return value

    def harmless() -> str:
        return rnd.choice((
            word, lambda: word().capitalize(), number, lambda: word().upper(),
            lambda: f"{rnd.randrange(9)}.{rnd.randrange(30)}.{rnd.randrange(9)}",
            lambda: f"20{rnd.randrange(10, 40)}-{rnd.randrange(1, 13):02}-{rnd.randrange(1, 29):02}",
            lambda: f"{word()}.{rnd.choice(['txt', 'html', 'com', 'py', 'mp4'])}",
            lambda: f"{word()}-{rnd.randrange(99)}", lambda: f"{word()}{rnd.randrange(1, 2100)}", lambda: f"{word()}_{word()}_{number()[:4]}",
            lambda: f"{pick(large, 1, 4)}-{number()[:5]}", lambda: f"{number()[:4]}{rnd.choice(['th', 'px', 'kg', 'm', 'ms', 'GB'])}",
            lambda: f"/{word()}/{word()}/{word()}{rnd.randrange(9)}", lambda: f"{word()}{word()}{word()}",
            lambda: f"{word().capitalize()}{word().capitalize()}{rnd.randrange(9)}",
        ))()

    def name() -> str:
        kind = rnd.random()
        if kind < 0.35:
            return rnd.choice(cues)
        if kind < 0.55:
            return rnd.choice((f"{word()}{{}}{rnd.choice(STEMS)}", f"{rnd.choice(STEMS)}{{}}{word()}", f"{rnd.choice(STEMS)}{{}}{rnd.choice(STEMS)}")).format(rnd.choice(["", "_", "-", "."]))
        return word() if kind < 0.8 else rnd.choice(plain)

    for _ in range(n):
        parts, place, kind = [word() for _ in range(rnd.randrange(0, 9))], None, rnd.random()
        case, joint = rnd.choice([str.lower, str.lower, str.upper, str.capitalize]), rnd.choice(JOINTS)
        quote = joint[-1] if joint[-1] in "\"'" else rnd.choice(["", "", "", '"', "'"])
        lead = f"{' '.join(parts)} {case(name())}{joint}{'' if joint[-1] == quote else quote}"
        if kind < 0.4:
            value = secret()
            text, place = f"{lead}{value}{quote}", (len(lead), len(lead) + len(value))
        elif kind < 0.75:
            text = f"{lead}{harmless()}{quote}"
        elif kind < 0.85:
            text = f"{' '.join(parts)} {case(name())} {word()} {harmless() if rnd.random() < 0.4 else word()}"
        else:
            text = " ".join([*parts, harmless(), word(), harmless()])
        text += rnd.choice([" ", ". ", ", ", "; "]) + " ".join(word() for _ in range(rnd.randrange(0, 9)))
        rows += [(t, y, [rnd.randrange(8), rnd.randrange(4), rnd.randrange(4)]) for t, y, _ in windows_of(text, [place] if place else [])][:1]
    return rows


def fit_windows(rows: list[Window], steps: int = 80, rate: float = 0.2, l2: float = 1e-3) -> Field | None:
    """A field fitted by Adam on the penalised likelihood of the windows; None if none has a secret."""
    rows = [r for r in rows if r[0]]
    if not any(any(r[1]) for r in rows):
        return None
    near: Counter[str] = Counter()
    for tokens, tags, _ in rows:
        for t, y in enumerate(tags):
            if y == B:
                near.update({w.lower() for w in tokens[max(0, t - 3) : t + 3] if w.isalpha()})
    lexicon = [w for w, n in sorted(near.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n > 2]
    symbols = {"": 0} | {"w" + w: k for k, w in enumerate(lexicon, 1)}
    for s in sorted({x for r in rows for w in r[0] for x in (shape(w), stem(w)) if x}):
        symbols.setdefault(s, len(symbols))
    ids_of, n, longest = _Symbols(symbols), len(rows), max(len(r[0]) for r in rows)
    ids, tags, mask = np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
    for k, (tokens, y, _) in enumerate(rows):
        ids[k, : len(y)], tags[k, : len(y)], mask[k, : len(y)] = [ids_of[w] for w in tokens], y, True
    files = np.array([r[2] for r in rows])
    size = len(symbols)
    w, f, trans = np.zeros((4, size, 3)), np.zeros((3, 8, 3)), np.zeros((3, 3))
    shifts = ((OWN, 0), (BEFORE, 1), (BEFORE2, 2), (AFTER, -1))

    def shifted(s: int) -> tuple[slice, slice]:  # where the token is, and where its neighbour is
        return (slice(s, None), slice(None, longest - s)) if s >= 0 else (slice(None, s), slice(-s, None))

    neighbour = {k: mask[:, shifted(s)[0]] & mask[:, shifted(s)[1]] for k, s in shifts}
    gold = np.eye(3)[tags] * mask[:, :, None]
    pair = mask[:, 1:]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, f, trans)]
    for step in range(1, steps + 1):
        e = sum(f[i][files[:, i]] for i in range(3))[:, None, :].repeat(longest, axis=1)
        for k, s in shifts:
            here, there = shifted(s)
            e[:, here] += w[k][ids[:, there]] * neighbour[k][:, :, None]
        # Forward and backward, each step scaled to sum 1; beyond a window's end nothing changes.
        move, emit = np.exp(trans), np.exp(e - e.max(axis=2, keepdims=True))
        alpha, beta = np.empty_like(e), np.ones_like(e)
        alpha[:, 0] = move[O] * emit[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            nxt = alpha[:, t - 1] @ move * emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt / nxt.sum(axis=1, keepdims=True), alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = (emit[:, t + 1] * beta[:, t + 1]) @ move.T
            beta[:, t] = np.where(mask[:, t + 1, None], nxt / nxt.sum(axis=1, keepdims=True), 1)
        post = alpha * beta
        post *= mask[:, :, None] / post.sum(axis=2, keepdims=True)
        both = alpha[:, :-1, :, None] * move * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
        both *= (pair / both.sum(axis=(2, 3)))[:, :, None, None]
        miss = gold - post
        gw, gf = np.zeros_like(w), np.zeros_like(f)
        for k, s in shifts:
            here, there = shifted(s)
            for y in range(3):
                gw[k, :, y] = np.bincount(ids[:, there][neighbour[k]], weights=miss[:, here, y][neighbour[k]], minlength=size)
        for i, y in np.ndindex(3, 3):
            gf[i, :, y] = np.bincount(files[:, i], weights=miss[:, :, y].sum(axis=1), minlength=8)
        gt = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum(axis=(0, 1)) - both.sum(axis=(0, 1))
        gt[O] += (gold[:, 0] - post[:, 0]).sum(axis=0)
        for p, g, (m, v) in zip((w, f, trans), (gw, gf, gt), moments):
            g = g / n - l2 * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(symbols, w, f, trans)


def has_base_match(text: Column) -> Column:
    """Whether base_spans finds anything, in built-in functions."""
    values = F.regexp_extract_all(text, F.lit("(?i)" + ASSIGN.pattern), F.lit(2))
    sure = F.exists(values, lambda v: F.length(v) >= 8) | text.rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    return F.coalesce(F.when(text.rlike(_MAYBE), sure), F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, invented: int = MADE_UP) -> Field | None:
    """A field fitted on at most ``sample`` documents with base matches, as many with weak ones only and as many
    with none, those whose hash is smallest, so that the same documents give the same field; and on ``invented``
    made-up lines. None where there is nothing to fit on.

    Documents are told apart in one pass that keeps 9 bytes of each.
    """
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    weak = text.rlike(WEAK.pattern) | text.rlike(ISSUED.pattern)
    kind = F.when(has_base_match(F.col("text")), 0).when(weak, 1).otherwise(2).cast("byte")
    keyed = docs.select("text", F.xxhash64("doc_id", row_key()).alias("h"))
    hashes = cut(keyed.select("h", kind.alias("kind")))
    chosen = {r["h"] for k in range(3) for r in hashes.where(F.col("kind") == k).select("h").distinct().orderBy("h").limit(sample).collect()}
    rows: list[Window] = []
    if chosen:
        few = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in sorted(chosen)], "h long"))
        once = keyed.join(few, "h").dropDuplicates(["h"]).select("text")
        got = once.mapInArrow(_windows, "tokens array<string>, tags array<int>, files array<int>").collect()  # at most WINDOWS of each
        rows = sorted((r["tokens"], r["tags"], r["files"]) for r in got)
    return fit_windows(rows + made_up(invented))


# --- scanning


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan(field):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        ids_of = _Symbols(model.symbols) if model else None
        for b in batches:
            out: list[tuple] = []
            for text in b.column(1):
                base, spans = find_secrets(text.as_py(), model, ids_of)
                kinds = [k for _, _, k in spans]
                out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            n_assign, n_access, n_hex, n_crf, sha, joined = zip(*out) if out else [()] * 6
            counts = [pa.array(x, pa.int64()) for x in (n_assign, n_access, n_hex)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha, pa.string()), pa.array(joined, pa.string()), pa.array(n_crf, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return rows


def scan_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf.

    spans are kind:start:end in code points. A null text is empty and has none; rows that repeat are
    returned as often as they come; long texts are read whole; other columns are ignored. n_crf counts the spans that
    only the field finds. No rows give no rows.
    """
    spark = docs.sparkSession
    field = spark.sparkContext.broadcast(fit(docs, sample))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(field), schema)


def _mask(field, at: int, mask: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        ids_of = _Symbols(model.symbols) if model else None
        for b in batches:
            texts = b.column(at).to_pylist()
            for k, text in enumerate(texts):
                end, parts = 0, []
                for s, e, _ in find_secrets(text, model, ids_of)[1]:
                    if s >= end:
                        parts += [text[end:s], mask]
                    end = max(end, e)
                if parts:
                    texts[k] = "".join([*parts, text[end:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return rows


def mask_secrets(docs: DataFrame, sample: int = SAMPLE, mask: str = MASK) -> DataFrame:
    """docs with each secret in text replaced by ``mask`` (overlapping spans by one), and n_chars, where
    docs has it, counted anew. Every row stays, repeated ones as often as they come, with all other columns as they
    are; a null text stays null, an empty one empty; no rows give no rows."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    out = docs.mapInArrow(_mask(field, docs.columns.index("text"), mask), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
