"""Personal data by base patterns and a skip-chain conditional random field.

Base patterns find emails, IP addresses, card and phone numbers, and an
assignment such as ``token = "..."`` a secret.  The field then labels the
tokens that hold a digit or an @ (all others are fixed to O, so the chain falls
apart at them): unary potentials from a token's shape and neighbours, chain
potentials between adjacent tokens, and skip potentials between occurrences of
one form anywhere in the document.  A form is shared by equal and by similar
tokens: the same number with other marks or without its country code, the same
address in other case or at another host.  Loopy belief propagation carries
labels over; tokens that get one and touch no base span are added.

The field learns from the base spans: as they are, and hidden, that is written
in a way that no pattern finds.  A hidden one counts with its label next to its
partner and as O without one, so the weights of shapes and pairs, which are
fitted together by pseudo-likelihood, come to add a token for what it repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import pieces, texts

KINDS = ("email", "ip", "card", "phone")
#: Spans that the field adds may also be secrets.
ALL_KINDS = (*KINDS, "secret")
LABELS = ("O", *ALL_KINDS)
#: Documents with a candidate that the field is fitted on at most, those with the smallest hash of their id.
MAX_TRAIN = 2_000
#: A token is added if its label's probability is this at least.
CERTAIN = 0.9
#: Score of a label that is known, beyond what any number of neighbours can say.
FIXED = 1e6
#: Messages have settled when none changes by more.
SETTLED = 1e-6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits unless the run's start does not match either
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_STRIP = ".,;:!?\"'()[]{}<>|*&%$#=`~"
_HINT = np.zeros(256, bool)
_HINT[48:58] = True
_HINT[64] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str):
    """Leftmost matches of local@domain.tld; every @ is looked at once, so long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns; matches that fail a check are dropped without another try."""
    out = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the token) of tokens with a digit or an @, without the marks around them."""
    out = []
    for i, m in enumerate(_TOKEN.finditer(text)):
        t = m.group()
        if any("0" <= c <= "9" or c == "@" for c in t):
            left = len(t) - len(t.lstrip(_STRIP))
            core = t.strip(_STRIP)
            if core:
                out.append((m.start() + left, m.start() + left + len(core), i))
    return out


def token_labels(nodes, spans) -> np.ndarray:
    """Label of the first base span that a node touches, 0 without one."""
    y, order, j = np.zeros(len(nodes), np.int64), sorted(spans, key=lambda x: (x[1], x[0])), 0
    for i, (s, e, _) in enumerate(nodes):
        while j < len(order) and order[j][2] <= s:
            j += 1
        for at in range(j, len(order)):
            k, a, b = order[at]
            if a >= e:
                break
            if b > s:
                y[i] = k + 1
                break
    return y


SECRET = LABELS.index("secret")
#: Names whose value is a secret, by themselves or as the last part of a name such as access_token.
_NAMED = frozenset("token secret password passwd key apikey".split())
_BLANK, _QUOTES = frozenset(" \t\r\f\v\xa0"), frozenset("\"'")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_NUMBER = re.compile(r"[0-9. ()+-]+")
_QUAD = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
#: Digits that two writings of one number share at its end.
TAIL = 9


def _assigned(text: str, s: int) -> bool:
    """Whether what begins at ``s`` is assigned to such a name in the same line: name, quote, ``=`` or ``:``, quote, with any blanks between."""

    def back(i: int, over: frozenset) -> int:
        while i and text[i - 1] in over:
            i -= 1
        return i

    i = back(s, _QUOTES)
    i = back(i if s - i < 2 else s, _BLANK)
    if not i or text[i - 1] not in "=:":
        return False
    i = back(i - 1, _BLANK)
    i -= i > 0 and text[i - 1] in _QUOTES
    first = i
    while first and (text[first - 1].isalnum()) and i - first < 9:
        first -= 1
    return text[first:i].lower() in _NAMED


def _secret(text: str, s: int, e: int) -> bool:
    return _LONG.fullmatch(text, s, e) is not None and any(c.isalpha() for c in text[s:e]) and _assigned(text, s)


def teacher(text: str, nodes, spans) -> np.ndarray:
    """Labels that are known for certain: of the base spans, and secrets that something is assigned."""
    y = token_labels(nodes, spans)
    for i in np.flatnonzero(y == 0).tolist():
        if _secret(text, *nodes[i][:2]):
            y[i] = SECRET
    return y


N_FEATURES = 19


def _shape(c: str, plus: bool, before: bool, after: bool, after_plus: bool, assigned: bool) -> tuple:
    """Binary features of one token, given what is around it."""
    d = _digits(c)
    only = len(d) + sum(ch in "-. ()+" for ch in c) == len(c)
    quad = _QUAD.fullmatch(c) is not None
    long = len(c) >= 16 and any(ch.isalpha() for ch in c)
    return (
        1, "@" in c, "@" in c and "." in c.rpartition("@")[2], quad, quad and all(int(p) <= 255 for p in c.split(".")), c.isdigit(), only and 13 <= len(d) <= 19, only and 13 <= len(d) <= 19 and luhn(d),
        only and len(d) < 9, only and 9 <= len(d) <= 12, plus, after_plus, before, after, not only, only and "-" in c, long, long and assigned, only and "." in c and not quad,
    )


def shape(text: str, nodes) -> np.ndarray:
    """Binary features of nodes."""
    x = np.zeros((len(nodes), N_FEATURES))
    near = [i > 0 and nodes[i][2] == nodes[i - 1][2] + 1 for i in range(len(nodes))] + [False]
    for i, (s, e, _) in enumerate(nodes):
        c = text[s:e]
        x[i] = _shape(c, s > 0 and text[s - 1] == "+" or c.startswith("+"), near[i], near[i + 1], near[i] and text[nodes[i - 1][0]] == "+", _secret(text, s, e))
    return x


def hidden(c: str, label: int) -> list[tuple[str, bool, bool]]:
    """Tokens of a base span, written so that no base pattern finds it; whether number tokens are before and after."""
    d = _digits(c)
    if LABELS[label] == "email":
        return [(c.rpartition("@")[0] + "@" + c.rpartition("@")[2].partition(".")[0], False, False)]
    if LABELS[label] == "ip":
        return [("[.]".join(c.split(".")), False, False), ("-".join(c.split(".")), False, False)]
    if LABELS[label] == "card":
        return [(".".join(d[k : k + 4] for k in range(0, len(d), 4)), False, False), ("0" + d, False, False), (d[:4], False, True), (d[4:8], True, True), (d[-4:], True, False)]
    return [(d, False, False), ("00" + d, False, False), (f"{d[:-7]}-{d[-7:]}", False, False)] if LABELS[label] == "phone" else [(c, False, False)]


def forms(text: str, nodes) -> list[tuple[tuple, list[int]]]:
    """What equal and similar tokens share, and the nodes of each occurrence, in order.

    An address with an @ has its local part; a number of six digits or more
    its last TAIL digits, one that is cut into adjacent tokens all of them
    together; other tokens of six characters or more have themselves.  Shorter
    numbers are equal by chance.
    """
    out: list[tuple[tuple, list[int]]] = []
    run: list[int] = []

    def flush() -> None:
        d = "".join(_digits(text[nodes[i][0] : nodes[i][1]]) for i in run)
        if len(run) > 1 and TAIL <= len(d):
            out.append((("number", d[-TAIL:]), run.copy()))
        run.clear()

    for i, (s, e, n) in enumerate(nodes):
        c = text[s:e]
        d = _digits(c)
        number = _NUMBER.fullmatch(c) is not None
        if run and (not number or n != nodes[i - 1][2] + 1 or c.startswith("+") or len(d) >= TAIL):
            flush()
        if "@" in c.strip("@"):
            out.append((("address", c.strip("@").partition("@")[0].lower()), [i]))
        elif len(d) >= 6 and (number or not any(ch.isalpha() for ch in c)):
            out.append((("number", d[-TAIL:]), [i]))
        elif not number and len(c) >= 6:
            out.append((("token", c.lower()), [i]))
        if number and len(d) < TAIL:
            run.append(i)
    flush()
    return out


def edges(text: str, nodes, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that are adjacent tokens, and pairs of one form.

    Each occurrence of a form is linked with one: the first with a known
    label, or else the first, so no label has to travel further than two links.
    """
    chain = [(i - 1, i) for i in range(1, len(nodes)) if nodes[i][2] == nodes[i - 1][2] + 1]
    by: dict[tuple, list[list[int]]] = {}
    for form, own in forms(text, nodes):
        by.setdefault(form, []).append(own)
    skip = []
    for found in by.values():
        if len(found) > 1:
            hub = next((own for own in found if known is not None and any(known[i] for i in own)), found[0])
            end = next((i for i in hub if known is not None and known[i]), hub[0])
            skip += [(end, i) for own in found if own is not hub for i in own if i not in hub]
    return np.array(chain, np.int64).reshape(-1, 2), np.array(sorted(set(skip)), np.int64).reshape(-1, 2)


class Field:
    """Weights: unary (features x labels), chain and skip (labels x labels)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Label probabilities after loopy sum-product message passing with damping, until the messages settle.

        A label has crossed all nodes after as many rounds; should messages
        still swing then, ever smaller steps bring them to rest.
        """
        score = x @ self.unary
        pairs = np.concatenate([chain, skip])
        if len(pairs):
            table = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
            to, frm = np.concatenate([pairs[:, 1], pairs[:, 0]]), np.concatenate([pairs[:, 0], pairs[:, 1]])
            table = np.concatenate([table, table.transpose(0, 2, 1)])
            n = len(pairs)
            back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
            msg = np.zeros((2 * n, len(LABELS)))
            step, rounds, change = 0.5, 0, np.inf
            while change > SETTLED:
                belief = score.copy()
                np.add.at(belief, to, msg)
                z = (belief[frm] - msg[back])[:, :, None] + table
                top = z.max(1, keepdims=True)
                new = np.log(np.exp(z - top).sum(1)) + top[:, 0]
                new = step * (new - new.max(1, keepdims=True) - msg)
                change = np.abs(new).max()
                msg += new
                rounds += 1
                if rounds > 2 * len(x) + 100:
                    step *= 0.9
            np.add.at(score, to, msg)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


#: Bit of each feature in the number of a pattern.
_BITS = 1 << np.arange(N_FEATURES, dtype=np.int64)
#: Stands for a neighbour or partner that isn't there.
NONE = -1


def count_text(text: str) -> Counter:
    """How often a text has each (feature pattern, label before, label after, label of the partner, label); labels are the teacher's."""
    nodes = candidates(text)
    y = teacher(text, nodes, base_spans(text)).tolist()
    chain, skip = edges(text, nodes, np.array(y))
    left, right, partner = ([NONE] * len(nodes) for _ in range(3))
    for i, j in chain.tolist():
        right[i], left[j] = y[j], y[i]
    for i, j in skip.tolist():
        partner[j] = y[i]
        if partner[i] == NONE:
            partner[i] = y[j]
    out = Counter(zip((shape(text, nodes).astype(np.int64) @ _BITS).tolist(), left, right, partner, y, strict=True))
    whole: list[tuple[str, int, int]] = []
    for (s, e, n), label in zip(nodes, y, strict=True):
        phone = LABELS[label] == "phone"
        if phone and whole and whole[-1][1] == label and whole[-1][2] == n - 1:
            whole[-1] = (whole[-1][0] + text[s:e], label, n)
        elif label:
            whole.append((text[s:e], label, n))
    for c, label, _ in whole:
        for part, before, after in hidden(c, label):
            # once by itself and once between tokens that are nothing
            for sides in (NONE, 0):
                near = [before or sides == 0, after or sides == 0]
                x = int(np.array(_shape(part, False, *near, False, False), np.int64) @ _BITS)
                # with a partner it has the partner's label; alone, or with a partner that is nothing, it is nothing
                for partner_label, own, n in ((label, label, 2), (NONE, 0, 3), (0, 0, 1)):
                    out[x, *[own if more else sides for more in (before, after)], partner_label, own] += n
    return out


def fit(texts_: list[str], steps: int = 400, rate: float = 0.5) -> Field:
    """Fits all weights together to :func:`count_text` of the texts."""
    counts: Counter = Counter()
    for t in texts_:
        counts.update(count_text(t))
    return fit_counts(counts, steps, rate)


def fit_counts(counts: Counter, steps: int = 400, rate: float = 0.5) -> Field:
    """Maximum pseudo-likelihood from the sum of :func:`count_text` over all texts: each label given its shape, its neighbours' and its partner's labels."""
    k = len(LABELS)
    rows: dict[tuple, np.ndarray] = {}
    for (*given, label), n in sorted(counts.items()):
        rows.setdefault(tuple(given), np.zeros(k))[label] += n
    given = np.array(list(rows), np.int64).reshape(-1, 4)
    x = (given[:, :1] & _BITS > 0).astype(float)
    left, right, partner = (np.eye(k + 1)[given[:, c]][:, :k] for c in (1, 2, 3))
    y = np.array(list(rows.values())).reshape(-1, k)
    total = y.sum(1, keepdims=True)
    w, chain, skip = np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))
    w[0, 0] = 1.0
    size = [np.full(a.shape, 1e-8) for a in (w, chain, skip)]
    for _ in range(steps if len(y) else 0):
        z = x @ w + left @ chain + right @ chain.T + partner @ skip
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p * total - y) / total.sum()
        both = partner.T @ g
        slopes = (x.T @ g + 1e-5 * w, left.T @ g + g.T @ right + 1e-5 * chain, both + both.T + 1e-5 * skip)
        for a, slope, s in zip((w, chain, skip), slopes, size, strict=True):
            s += slope * slope
            a -= rate * slope / np.sqrt(s)
    return Field(w, chain, skip)


def find_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and those that the field adds, sorted by kind and start."""
    base = sorted(base_spans(text))
    nodes = candidates(text)
    if not nodes:
        return base, []
    in_base = token_labels(nodes, base) > 0
    # what the teacher knows is certain
    y = teacher(text, nodes, base)
    c, s = edges(text, nodes, y)
    x = shape(text, nodes)
    known = np.flatnonzero(y)
    clamp = np.zeros((len(nodes), len(LABELS)))
    clamp[known, y[known]] = FIXED
    p = Field(np.vstack([field.unary, np.eye(len(LABELS))]), field.chain, field.skip).marginals(np.hstack([x, clamp]), c, s)
    added: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(~in_base & (p.argmax(1) > 0) & (p.max(1) >= CERTAIN)).tolist():
        kind, (a, b, n) = int(p[i].argmax()) - 1, nodes[i]
        if added and kind == 3 and added[-1][0] == 3 and nodes[i - 1][1] == added[-1][2] and nodes[i - 1][2] == n - 1:
            added[-1] = (3, added[-1][1], b)
        else:
            added.append((kind, a, b))
    return base, sorted(added)


def _join(spans) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _hinted(part: pa.RecordBatch) -> np.ndarray:
    raw, offs = texts(part.column("text"))
    c = np.concatenate([[0], np.cumsum(_HINT[raw])])
    return c[offs[1:]] > c[offs[:-1]]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Field:
    """Fits the field on at most ``max_train`` documents with a digit or an @, whatever their length.

    Documents are chosen by the hash of their id, those without an id by that
    of their text; repeats of a chosen row count too.  Texts are counted where
    they are: the driver gets numbers of label pairs and feature patterns.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    src = src.withColumn("t", F.xxhash64("text"))
    some = src.select(F.when(F.col("id").isNull(), F.col("t")).otherwise(F.xxhash64("id")).alias("h"), F.col("id").alias("i"), F.col("t").alias("u")).orderBy("h", "i", "u").limit(max_train).select("i", "u").distinct()

    names = ("x", "before", "after", "partner", "label")

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column("text"):
                total.update(count_text(x.as_py()))
        keys = list(zip(*total, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in keys), pa.array(list(total.values()), pa.int64())], names=[*names, "n"])

    # the broadcast side has max_train numbers at most
    taken = src.join(F.broadcast(some), F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u"))).select("text")
    got = taken.mapInArrow(run, ", ".join(f"{c} long" for c in (*names, "n"))).groupBy(*names).agg(F.sum("n").alias("n")).collect()
    return fit_counts(Counter({tuple(r)[:-1]: r["n"] for r in got}))


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns a row per input row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_secret, n_spans.

    spans holds base and added spans as kind:start:end in code points;
    n_added counts those that the field adds, n_secret the secrets among them,
    n_spans all.  A null text counts as empty and has no span; a text of any
    length is read whole, and its field has a node for each token with a digit
    or an @.  Null ids stay null; rows that share an id and repeated rows each
    get their row; of labels that tie, the first of LABELS counts; other
    columns, whatever their names, are ignored; an empty table gives an empty
    result.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                hinted, rows = _hinted(part), []
                for i in range(part.num_rows):
                    base, added = find_spans(part.column("text")[i].as_py(), field) if hinted[i] else ([], [])
                    counts = [sum(k == j for k, _, _ in base) for j in range(4)]
                    rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + added)), len(added), sum(ALL_KINDS[k] == "secret" for k, _, _ in added), len(base) + len(added)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret", "n_spans"])

    src = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return src.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long").withColumnRenamed("id", id_col)
