"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, remember

#: Kinds of the fixed patterns; the field knows secrets (keys, tokens) besides.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
# Fixed patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match never begins inside digits, and need not be sought there
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns: leftmost, not overlapping, failing matches dropped."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_SIGNS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- the conditional random field

#: O, and of each kind the first word of an item (B) and its further words (I).
LABELS = ("O", *(f"{part}-{kind}" for kind in ALL_KINDS for part in "BI"))
_FEATURES = 1 << 12
_LOT = 200_000  # places decoded at once, or one text
_TOKEN = re.compile(r"\S+")
#: Every plausible span holds one of these: texts without any need no decoding.
_ANY = re.compile("[0-9@]")
_AT, _DOT = re.compile(r"\bat\b", re.I), re.compile(r"\bdot\b", re.I)
_CUES = frozenset("phone tel telephone call fax mobile cell mail email e-mail contact write ip host server address card visa credit number from at dot token key secret password api com org net edu de = : (at) (dot) [at] [dot] with or and".split())
_DIGITS_OF = re.compile("[0-9]")
_SIGNS = ",.;:!?#$%&*|\"'`<>{}~^"


def shape(word: str) -> str:
    """Kinds of signs in order: 9 for a digit, a and A for letters; runs over four are cut to four."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_A-Z]", "a", re.sub(r"[A-Z]", "A", word)))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", s)


def _own(word: str) -> list[int]:
    """Feature numbers of a word, apart from its place."""
    digits = len(_DIGITS_OF.findall(word))
    core = word.strip(_SIGNS)
    low = core.lower() if core else word
    letters = sum(c.isalpha() for c in core)
    code = len(core) >= 16 and digits >= 2 and letters >= 2 and re.fullmatch(r"[A-Za-z0-9_+/=.-]+", core) is not None
    names = [f"s={shape(word)}" if len(core) < 16 else "s=long", f"core={shape(core)}" if len(core) < 16 else f"code={code}", f"d={min(digits, 20)}", f"dots={min(core.count('.'), 5)}", f"at={'@' in word}", f"p={core[:1] if not core[:1].isalpha() else 'a'}", f"cue={low if low in _CUES else ''}", f"dash={min(word.count('-'), 5)}", f"brackets={word[0] + core[-1:] if word[0] in '([' else ''}", f"n={min(len(core), 12)},{digits > 0}"]
    return [crc32(n.encode()) % _FEATURES for n in names]


@cache
def labelled_table(seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences as words and their labels, from patterns."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["th", "en", "ra", "lo", "is", "un", "der", "que", "sa", "mi"]) for _ in range(rng.randint(1, 4)))

    def card():
        x = d(15)
        last = next(c for c in "0123456789" if _luhn(x + c))
        return x + last

    def email():
        n, h = rng.choice([f"{word()}.{word()}{d(2)}", f"{word()}.{word()}", word(), f"{word()}{d(3)}"]), word()
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("(AT)", "(DOT)"), ("[At]", "[Dot]"), ("at", "dot"), ("at", "dot"), ("AT", "DOT")])
        end = rng.choice(["com", "org", "net", "de", "edu"])
        return rng.choice([[f"{n}@{h}.{end}"], [n, at, h, dot, end], [n, at, h, dot, end], [f"{n}(at){h}(dot){end}"], [f"{n}[at]{h}.{end}"]])

    def phone():
        a, b, c = d(3), d(3), d(4)
        return rng.choice([["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+44{d(10)}"], [f"{a}.{b}.{c}"], ["+1", a, b, c]])

    def ip():
        return [".".join(str(rng.randint(0, 255)) for _ in range(4)) + rng.choice(["", "", f":{d(4)}"])]

    def cards():
        x = card()
        return rng.choice([[x], [x[:4], x[4:8], x[8:12], x[12:]], ["-".join((x[:4], x[4:8], x[8:12], x[12:]))], [".".join((x[:4], x[4:8], x[8:12], x[12:]))]])

    def secret():
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 40, 64])))
        mixed = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(rng.randint(20, 44))) + d(2)
        x = rng.choice([hexes, hexes, hexes.upper(), mixed, "sk_" + mixed])
        return [rng.choice([x, f'"{x}"', f'"{x}"', f"'{x}'"])]

    def other():
        return rng.choice([[d(1)], [d(2)], [d(3)], [d(4)], [f"{d(1)}.{d(1)}"], [f"{d(1)}.{d(2)}.{d(1)}"], [f"{d(4)}-{d(2)}-{d(2)}"], [f"{d(2)}:{d(2)}"], [f"${d(3)}"], [f"{d(2)}%"], [f"#{d(6)}"], [f"{d(12)}"], [d(6)], [d(8)], [word() + d(2)], [f"v{d(1)}.{d(1)}"], [f"({d(4)})"], [f"/{word()}/{d(5)}"], ["version", d(1)], ["CC", "BY", f"{d(1)}.{d(1)}"], [f"@{word()}"], [f"{d(4)}-{d(4)}"], [f"{d(3)},{d(3)}"], ["at", word(), "dot"], ["at", d(2)], [word(), "at", word()], ["look", "at", "the", "dot"], [word() * 4], [f"{word()}-{word()}-{word()}-{d(2)}"], ["token", "=", word()], ["key", word()], ["dot", word()]])

    def cue(kind):
        if kind == "secret" and rng.random() < 0.6:
            return [rng.choice(["token", "key", "secret", "TOKEN", "Token"]), rng.choice(["=", ":", "is"])]
        return rng.choice([[], [], [rng.choice({"email": ["mail", "contact", "write"], "phone": ["phone", "call", "tel"], "ip": ["ip", "host", "from"], "card": ["card", "visa", "number"], "secret": ["token", "key", "secret", "api"]}[kind])]])

    makers = {"email": email, "phone": phone, "ip": ip, "card": cards, "secret": secret}
    table = []
    for _ in range(600):
        words, labels = [], []
        for _ in range(rng.randint(1, 3)):
            words += (w := [word() for _ in range(rng.randint(0, 4))])
            labels += ["O"] * len(w)
            kind = rng.choice([*ALL_KINDS, "O", "O", "O", "O"])
            pre = cue(kind) if kind != "O" else []
            words += pre
            labels += ["O"] * len(pre)
            for _ in range(rng.choice([1, 1, 2, 3, 5]) if kind != "O" else 1):  # lists of items of one kind
                own = makers[kind]() if kind != "O" else other()
                own = [*own[:-1], own[-1] + rng.choice(["", "", "", ".", ",", ";", "!!", "###", "$$$"] if kind != "O" else ["", "", ".", ",", "!!", "***"])]
                words += own
                labels += [f"{'I' if k else 'B'}-{kind}" for k in range(len(own))] if kind != "O" else ["O"] * len(own)
        words += (w := [word() for _ in range(rng.randint(1, 4))])
        labels += ["O"] * len(w)
        table.append((words, labels))
    return table


class Crf:
    """Weights: of own, previous and next word's features for each label, and of label pairs."""

    def __init__(self, most: int = 100_000):
        self.most = most
        self.w = np.zeros((3, _FEATURES, len(LABELS)))
        self.t = np.zeros((len(LABELS), len(LABELS)))
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 3, len(LABELS)), np.float32)

    def _pad(self, sequences: list[list[str]]):
        """Feature numbers (sequence, place, feature) of words and a mask."""
        top = max(map(len, sequences))
        x = np.zeros((len(sequences), top, len(_own("x"))), np.int64)
        mask = np.zeros((len(sequences), top), bool)
        for i, s in enumerate(sequences):
            x[i, : len(s)] = [_own(w) for w in s]
            mask[i, : len(s)] = True
        return x, mask

    def scores(self, x, mask):
        """Label scores at each place."""
        part = [w[x].sum(axis=2) * mask[..., None] for w in self.w]
        out = part[0].copy()
        out[:, 1:] += part[1][:, :-1]
        out[:, :-1] += part[2][:, 1:]
        return out

    def prepared(self, table) -> dict:
        """A labelled table as arrays: features, mask, labels, and the places of each feature in order."""
        x, mask = self._pad([w for w, _ in table])
        y = np.zeros(mask.shape, np.int64)
        for i, (_, labels) in enumerate(table):
            y[i, : len(labels)] = [LABELS.index(k) for k in labels]
        gold = np.eye(len(LABELS))[y] * mask[..., None]
        pair = mask[:, 1:] & mask[:, :-1]
        place, which = np.nonzero(np.repeat(mask.ravel()[:, None], x.shape[2], axis=1))
        feature = x.reshape(-1, x.shape[2])[place, which]
        order = np.argsort(feature, kind="stable")
        begin = np.flatnonzero(np.diff(feature[order], prepend=-1))
        return {"x": x, "mask": mask, "gold": gold, "pair": pair, "gold_t": np.einsum("ijk,ijl,ij->kl", gold[:, :-1], gold[:, 1:], pair), "place": place[order], "begin": begin, "feature": feature[order][begin]}

    def gradient(self, given: dict, decay: float = 0.0):
        """Log-likelihood of a prepared table, and its gradients to both kinds of weights, by forward and backward sums."""
        x, mask, gold, pair = (given[k] for k in ("x", "mask", "gold", "pair"))
        n = x.shape[1]
        e = self.scores(x, mask)
        fwd, back = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for j in range(1, n):
            v = np.logaddexp.reduce(fwd[:, j - 1, :, None] + self.t, axis=1) + e[:, j]
            fwd[:, j] = np.where(mask[:, j, None], v, fwd[:, j - 1])
        for j in range(n - 2, -1, -1):
            v = np.logaddexp.reduce(self.t + (e[:, j + 1] + back[:, j + 1])[:, None, :], axis=2)
            back[:, j] = np.where(mask[:, j + 1, None], v, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + back - z[:, None, None]) * mask[..., None]
        joint = np.exp(fwd[:, :-1, :, None] + self.t + (e[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None])
        gt = given["gold_t"] - np.einsum("ijkl,ij->kl", joint, pair) - decay * self.t
        diff = gold - p
        gw = -decay * self.w
        shifted = [diff, np.pad(diff[:, 1:], ((0, 0), (0, 1), (0, 0))), np.pad(diff[:, :-1], ((0, 0), (1, 0), (0, 0)))]
        for k, s in enumerate(shifted):
            gw[k, given["feature"]] += np.add.reduceat(s.reshape(-1, len(LABELS))[given["place"]], given["begin"], axis=0)
        likelihood = float((e * gold).sum() + (given["gold_t"] * self.t).sum() - z.sum())
        return likelihood, gw, gt

    def fit(self, table, rounds: int = 40, rate: float = 0.3, decay: float = 1e-4) -> Crf:
        """Maximum likelihood by full-batch gradients with per-weight step sizes."""
        seen_w, seen_t = np.full(self.w.shape, 1e-8), np.full(self.t.shape, 1e-8)
        given = self.prepared(table)
        for _ in range(rounds):
            _, gw, gt = self.gradient(given, decay)
            seen_w += gw**2
            seen_t += gt**2
            self.w += rate * gw / np.sqrt(seen_w)
            self.t += rate * gt / np.sqrt(seen_t)
        return self

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Row of each word in the table of label scores, from 1."""
        rows = self.rows
        out = np.empty(len(words), np.int32)
        new = []
        for j, w in enumerate(words):
            k = rows.get(w)
            if k is None:
                k = rows[w] = len(rows) + 1
                new.append(w)
            out[j] = k
        if new:
            last = len(rows)
            if last >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(last, len(self.table)), 3, len(LABELS)), np.float32)])
            for at in range(0, len(new), 2000):
                some = new[at : at + 2000]
                first = last - len(new) + 1 + at
                self.table[first : first + len(some)] = self.w[:, np.array([_own(w) for w in some])].sum(axis=2).transpose(1, 0, 2)
        return out

    def decode(self, sequences: list[list[str]]) -> list[list[str]]:
        """The likeliest labels of each sequence, by Viterbi over all sequences at once."""
        return [[LABELS[k] for k in path.tolist()] for path in self.paths(sequences)]

    def paths(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Label numbers of each sequence; sequences may be empty. Beyond ``most`` words the later half goes: the words that came first are the common ones."""
        if len(self.rows) > self.most:
            self.rows = dict(islice(self.rows.items(), self.most // 2))  # numbered in this order
        size = np.array([len(s) for s in sequences], np.int64)
        if not len(size) or not size.max():
            return [np.zeros(0, np.int64) for _ in sequences]
        order = np.argsort(-size, kind="stable")  # longest first: at a place, a leading part is still running
        top = int(size.max())
        rows = np.zeros((top + 2, len(size)), np.int32)
        for i, k in enumerate(order.tolist()):
            rows[1 : size[k] + 1, i] = self._numbers(sequences[k])
        table, t = self.table, self.t.astype(np.float32)
        live = np.searchsorted(-size[order], -np.arange(1, top + 1), "right")
        back = np.zeros((top, len(size), len(LABELS)), np.int8)
        best = np.zeros((len(size), len(LABELS)), np.float32)
        for j in range(top):
            m = int(live[j])
            e = table[rows[j + 1, :m], 0] + table[rows[j, :m], 1] + table[rows[j + 2, :m], 2]
            if not j:
                best[:m] = e
                continue
            step = best[:m, None, :] + t.T[None]
            choice = step.argmax(axis=2)
            back[j, :m] = choice
            best[:m] = np.take_along_axis(step, choice[..., None], 2)[..., 0] + e
        label = best.argmax(axis=1)
        path = np.zeros((top, len(size)), np.int8)
        for j in range(top - 1, -1, -1):
            m = int(live[j])
            path[j, :m] = label[:m]
            label[:m] = back[j, np.arange(m), label[:m]]
        out: list = [None] * len(size)
        for i, k in enumerate(order.tolist()):
            out[k] = path[: size[k], i].astype(np.int64)
        return out


@cache
def model() -> Crf:
    return Crf().fit(labelled_table())


_DIGITS = {"email": (0, 99), "ip": (4, 16), "card": (13, 19), "phone": (7, 15), "secret": (2, 400)}


def _plausible(kind: str, s: str) -> bool:
    """What every span of a kind has, whatever its shape."""
    low, high = _DIGITS[kind]
    if not low <= len(_DIGITS_OF.findall(s)) <= high:
        return False
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+?(@|\s*[(\[]\s*at\s*[)\]]\s*|\s+at\s+)[^\s@]+?((\.|\s*[(\[]\s*dot\s*[)\]]\s*|\s+dot\s+)[\w-]+)+", s, re.I))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9 .\s-]+", s)) and _luhn("".join(_DIGITS_OF.findall(s)))
    if kind == "secret":
        return bool(re.fullmatch(r"[A-Za-z0-9_+/=.-]{16,}", s)) and re.search("[A-Za-z]", s) is not None
    if kind == "ip":
        return all(p and int(p) <= 255 for p in s.split(":")[0].split(".")) if re.fullmatch(r"[0-9.]+(:[0-9]+)?", s) else False
    return bool(re.fullmatch(r"[+0-9().\s-]+", s))


def _parts(kind: str, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Plausible spans among the words of one item: all of it, or else parts that cover the most words, of sizes as even as can be.

    A part has at most 64 words: no kind but the email has more than 19 digits.
    """

    def trimmed(k, j):
        s = text[words[k][0] : words[j - 1][1]]
        a = words[k][0] + len(s) - len(s.lstrip(_SIGNS))
        s = s.strip(_SIGNS)
        return (a, a + len(s)) if s and _plausible(kind, s) else None

    whole = trimmed(0, len(words)) if words else None
    if whole or len(words) < 2:
        return [whole] if whole else []
    high = _DIGITS[kind][1]
    digits = [len(_DIGITS_OF.findall(text, a, b)) for a, b in words]
    best: list = [(0, 0, None)] * (len(words) + 1)  # words not covered, squares of digits, the part that begins here and where it ends
    for k in range(len(words) - 1, -1, -1):
        best[k] = (best[k + 1][0] + 1, best[k + 1][1], None)
        n = 0
        for j in range(k + 1, min(len(words), k + 64) + 1):
            n += digits[j - 1]
            if n > high:
                break
            span = trimmed(k, j)
            if span:
                best[k] = min(best[k], (best[j][0], best[j][1] + max(1, n) ** 2, (span, j)), key=lambda x: x[:2])
    out, k = [], 0
    while k < len(words):
        found = best[k][2]
        if found:
            out.append(found[0])
        k = found[1] if found else k + 1
    return out


def _free(words: list[tuple[int, int]], starts: list[int], ends: list[int]) -> list[list[tuple[int, int]]]:
    """Runs of an item's words that no fixed pattern's span touches; ``starts`` and ``ends`` are of spans that do not overlap."""
    out: list[list] = [[]]
    for a, b in words:
        k = bisect_left(starts, b) - 1
        if k >= 0 and ends[k] > a:
            out.append([])
        else:
            out[-1].append((a, b))
    return [w for w in out if w]


def _cover(spans: list) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    return starts, ends


def added_spans(texts: list[str], crf: Crf, base: list[list]) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds beside the fixed patterns' spans.

    Whole texts are decoded, but for those that hold nothing of which every span has something.
    """
    asked = [i for i, t in enumerate(texts) if _ANY.search(t) or _DOT.search(t) and _AT.search(t)]
    covers = {i: _cover(base[i]) for i in asked}
    places = {i: [m.span() for m in _TOKEN.finditer(texts[i])] for i in asked}
    out: list[list] = [[] for _ in texts]
    order = sorted(asked, key=lambda i: len(places[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(places[order[end]]) <= _LOT:
            end += 1
        own = order[at:end]
        at = end
        for i, path in zip(own, crf.paths([[texts[i][a:b] for a, b in places[i]] for i in own])):
            w = places[i]
            for k in np.flatnonzero(path % 2 == 1).tolist():  # the first word of an item
                j, kind = k + 1, LABELS[path[k]][2:]
                while j < len(w) and path[j] == path[k] + 1:
                    j += 1
                for free in _free(w[k:j], *covers[i]):
                    out[i] += [(kind, *span) for span in _parts(kind, texts[i], free)]
    return [sorted(s, key=lambda x: x[1]) for s in out]


def _text_of(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, n_found) of every row.

    The four counts and the digest are of the fixed patterns' spans; ``spans`` holds
    these and the field's, which never overlap them. The field also finds secrets
    (keys and tokens), listed last with kind ``secret``. ``n_added`` counts the field's
    spans, ``n_found`` all. Null texts are empty; repeated rows and null ids stay;
    whole texts are read; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        remember()
        crf = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                lot = b.slice(at, 1000)
                texts = lot.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, crf, base)
                count = [[sum(k == kind for k, _, _ in s) for s in base] for kind in KINDS]
                digest = [hashlib.sha256(_text_of(s).encode()).hexdigest() for s in base]
                cols = [lot.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(digest, pa.string()), pa.array([_text_of([*s, *m]) for s, m in zip(base, more)], pa.string()), pa.array([len(m) for m in more], pa.int64()), pa.array([sum(k == "secret" for k, _, _ in m) for m in more], pa.int64()), pa.array([len(s) + len(m) for s, m in zip(base, more)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_secret", "n_found"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_found long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by ``<kind>``; other columns stay, n_chars follows the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        remember()
        crf = sent.value
        for b in portions(batches, 400):
            texts = b.column(text_col).to_pylist()
            known = [t or "" for t in texts]
            base = [base_spans(t) for t in known]
            out = []
            for t, s, m in zip(texts, base, added_spans(known, crf, base)):
                done, parts = 0, []
                for kind, a, z in sorted([*s, *m], key=lambda x: (x[1], -x[2])):
                    if z > done:  # overlapping spans are covered by one mark
                        parts += [t[done:a] if a > done else "", f"<{kind}>" if a >= done else ""]
                        done = z
                out.append(None if t is None else "".join(parts) + t[done:])
            cols = {n: b.column(n) for n in b.schema.names} | {text_col: pa.array(out, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)
