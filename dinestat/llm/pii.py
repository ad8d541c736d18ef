"""Personal data: base patterns, and a tagger that adds what they miss.

Every whole text is searched by the base patterns. A character BiLSTM with a CRF then
reads overlapping windows; each window is decoded for itself and the spans of all windows
of a text are reconciled at once: of those that overlap, the set with most votes stays.
Only windows that hold a digit, an at sign, a bracketed "at" or a "dot" by itself are read,
since a span without one is admitted by no kind; all other windows decode to nothing by
that rule.

The tagger is trained from labelled spans on a bounded sample of the documents: what the
base patterns find there, and spelt-out or regrouped forms put into that text, among
numbers that are no personal data. It runs within tasks; no row moves.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import string
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm.bilstm_crf import Tagger, symbols, train
from dinestat.llm.common import column, labelled_texts, per_text, shared

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and between the starts of two; spans up to STEP are seen whole,
#: longer ones by a wider window around what is cut.
WIDTH, STEP = 96, 48

Span = tuple[int, int, int]  # kind, start, end

# --- base patterns -----------------------------------------------------------------

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = 2 * value - 9 * (value > 4)
        total += value
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the address pattern, found from each at sign outwards."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns that pass their checks, by kind and start."""
    spans = [(0, *place) for place in emails(text)]
    for found in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in found[0].split(".")):
            spans.append((1, *found.span()))
    for found in CARD.finditer(text):
        digits = digits_of(found[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *found.span()))
    for found in PHONE.finditer(text):
        if 8 <= len(digits_of(found[0])) <= 15:
            spans.append((3, *found.span()))
    return spans


# --- labelled windows --------------------------------------------------------------

DEFAULT_TEXT = "the quick brown fox jumps over a lazy dog and sees what there is to find. "


def _spelt(rng: np.random.Generator, kind: int) -> str:
    """One made-up item of a kind, in one of its usual spellings."""

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def letters(low: int, high: int) -> str:
        return "".join(rng.choice(list(string.ascii_lowercase), rng.integers(low, high)))

    def either(*forms: str) -> str:
        return forms[rng.integers(len(forms))]

    if kind == 0:
        name = either(letters(2, 9), letters(2, 7) + "." + letters(2, 7), letters(2, 6) + digits(2))
        host = either(letters(3, 9), letters(3, 6) + digits(1)) + either("", "." + letters(3, 8))
        end = either("com", "org", "net", "de", "info")
        at, dot = either(
            ("@", "."), ("@", "."), (" (at) ", "."),
            ("[at]", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "),
        )
        if at == " at ":
            name = name.replace(".", dot)
        return name + at + host.replace(".", dot) + dot + end
    if kind == 1:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return either(".", ".", ".", "[.]", " . ").join(parts)
    if kind == 2:
        if rng.random() < 0.25:
            d = "3" + digits(14)
            groups, gap = (d[:4], d[4:10], d[10:]), either("", " ", "-")
        else:
            d = digits(16)
            groups, gap = (d[:4], d[4:8], d[8:12], d[12:]), either("", " ", "-", ".", "", " ")
        return gap.join(groups)
    a, b, c = digits(3), digits(3), digits(4)
    return either(
        f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {digits(2)} {digits(7)}",
        f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a} {digits(7)}", f"{a}.{b}.{c}", f"00{rng.integers(1, 99)} {a} {digits(6)}",
        f"{a} {b} {c}",
    )


def _other(rng: np.random.Generator) -> str:
    """A number or code that is no personal data."""
    n = [str(x) for x in rng.integers(0, 10000, 4)]
    forms = (
        f"{rng.integers(1900, 2100)}", f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 32)}",
        f"{rng.integers(0, 24)}:{rng.integers(10, 60)}", f"{n[0]}.{n[1][:1]}", f"version {n[0][:1]}.{n[1][:1]}.{n[2][:1]}",
        f"{n[0]},{n[1][:3]}.{n[2][:2]}", f"({n[0][:2]})", f"#{n[0]}", f"{n[0]}{n[1]}", f"page {n[0][:3]}", f"@{n[0]}",
        'token = "' + "".join(rng.choice(list("0123456789abcdef"), 40)) + '"', f"{n[0]}%", f"({n[0]}) {n[1]}/{n[2]}",
        f"at {n[0][:2]}", "the dot at the end", "a dot",
    )
    return forms[rng.integers(len(forms))]


def labelled_windows(slices: list[str], n: int, width: int = 64, seed: int = 5):
    """``n`` windows of text with items put in, as symbols, and their tags."""
    rng = np.random.default_rng(seed)
    slices = [s for s in slices if s.strip()] or [DEFAULT_TEXT]
    ids = np.full((n, width), 95, np.uint8)
    tags = np.zeros((n, width), np.int64)
    for row in range(n):
        text = slices[rng.integers(len(slices))]
        spans: list[Span] = []
        for _ in range(rng.integers(0, 3)):
            inside = {i for _, s, e in spans for i in range(s, e)}
            blanks = [i for i, c in enumerate(text) if c == " " and i not in inside] or [0]
            place = blanks[rng.integers(len(blanks))]
            kind = rng.integers(len(KINDS)) if rng.random() < 0.65 else -1
            item = _spelt(rng, kind) if kind >= 0 else _other(rng)
            tail = ("", "", ".", ",", "!!", "%%%", "***")[rng.integers(7)]
            more = len(item) + len(tail) + 1
            spans = [(k, s, e) if e <= place else (k, s + more, e + more) for k, s, e in spans]
            if kind >= 0:
                spans.append((kind, place + 1, place + 1 + len(item)))
            text = text[: place + 1] + item + tail + text[place:]
        base = base_spans(text)
        spans = [s for s in spans if not any(b[1] < s[2] and s[1] < b[2] for b in base)] + base
        middle = (spans[0][1] + spans[0][2]) // 2 if spans else len(text) // 2
        low = max(0, min(len(text) - width, middle - int(rng.integers(10, width - 10))))
        own = symbols(text[low : low + width])
        ids[row, : len(own)] = own
        for kind, start, end in sorted(spans, key=lambda s: -s[0]):
            start, end = max(0, start - low), min(width, end - low)
            if start < end:
                tags[row, start:end] = 2 * kind + 2
                tags[row, start] = 2 * kind + 1
    return ids, tags


def fit_tagger(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 300, windows: int = 3000
) -> Tagger:
    """A tagger trained on windows of at most ``sample`` documents.

    Each gives eight slices from all over its text. Without documents the windows are
    made in a stock sentence.
    """
    texts = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))

    def start():
        return lambda texts: [
            [[t[p : p + WIDTH] for p in np.linspace(0, max(0, len(t) - WIDTH), 8).astype(int)] for t in texts]
        ]

    named = labelled_texts(texts, texts.select("id").where("id is not null"), sample, "id")
    field = T.StructField("slices", T.ArrayType(T.StringType()))
    rows = per_text(named, ["id"], "text", start, [field]).orderBy("id", "slices").limit(sample)

    def trained(slices: list[str]) -> bytes:
        return pickle.dumps(vars(train(*labelled_windows(slices, windows), len(KINDS)).light()))

    def run(batches):
        slices = [s for batch in batches for own in batch.column(0).to_pylist() for s in own]
        yield pa.RecordBatch.from_pydict({"model": pa.array([trained(slices)], pa.binary())})

    # One task trains, and is run again if its executor is lost; no rows, no task.
    found = rows.select("slices").mapInArrow(run, "model binary").collect()
    return Tagger(**pickle.loads(found[0]["model"] if found else trained([])))


# --- search ------------------------------------------------------------------------

ANCHOR = re.compile(r"[0-9]+|@|[(\[] ?at ?[)\]]|\bdot\b", re.IGNORECASE)
DATE = re.compile(
    r"(?<![0-9])(?:(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}"
    r"|[0-9]{1,2}[-. ][0-9]{1,2}[-. ](?:19|20)[0-9]{2})(?![0-9])"
)
MARK = re.compile(r"@|[(\[] ?at ?[)\]]", re.IGNORECASE)
SIGN = re.compile(MARK.pattern + r"|\bdot\b", re.IGNORECASE)
NUMBER = re.compile(r"[-+0-9 ().]+")
#: Characters of the longest address, 64 and 255 around the mark, with room for marks in words.
LONGEST_ADDRESS = 512
#: An address in words only, which needs its dots spelt out as well.
IN_WORDS = re.compile(r"[\w+-]+(?: dot [\w+-]+)* at [\w-]+(?: dot [\w-]+)+", re.IGNORECASE)


def admitted(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a span can be of its kind: its own marks, digits and bounds."""
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return False
    item = text[start:end]
    digits = digits_of(item)
    if kind == 0:
        parts = MARK.split(item)
        dotted = re.search(r"\w ?(\.|[(\[]dot[)\]]) ?\w", parts[-1])
        if len(parts) == 1:
            return bool(IN_WORDS.fullmatch(item))
        return len(parts) == 2 and bool(parts[0].strip()) and bool(dotted)
    if kind == 1:
        parts = re.split(r" ?\[?\.\]? ?", item)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    if not NUMBER.fullmatch(item):
        return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and not DATE.search(item)


def reconciled(votes: dict[Span, int], taken: list[Span]) -> list[Span]:
    """Disjoint spans of most votes by length in total, clear of those taken already."""
    # Ends of all that is taken, and where what reaches such an end starts, both ascending.
    starts, ends = [], []
    for _, start, end in sorted(taken, key=lambda s: s[1:]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def is_free(span: Span) -> bool:
        at = bisect_right(ends, span[1])
        return at == len(ends) or starts[at] >= span[2]

    spans = sorted(filter(is_free, votes), key=lambda s: (s[2], s[1], s[0]))
    last = [s[2] for s in spans]
    best = [0]  # by number of spans looked at
    before = []  # spans looked at before the one is taken; None where it is not
    for i, span in enumerate(spans):
        fits = bisect_right(last, span[1], 0, i)
        value = best[fits] + votes[span] * (span[2] - span[1])
        before.append(fits if value > best[i] else None)
        best.append(max(value, best[i]))
    out, i = [], len(spans)
    while i:
        if before[i - 1] is None:
            i -= 1
        else:
            out.append(spans[i - 1])
            i = before[i - 1]
    return out[::-1]


def whole_spans(text: str, parts: list[Span], model: Tagger) -> dict[Span, int]:
    """Admitted spans of more than STEP characters by the number of cut parts they hold.

    A window that is wide enough is read around all parts of a kind that overlap or meet,
    and a wider one for as long as its edge cuts the span in turn. Parts that no admitted
    span can hold are left out: of an address, those far from any mark.
    """

    def possible(kind: int, start: int, end: int) -> bool:
        item = text[start:end]
        if kind == 0:
            if end - start > LONGEST_ADDRESS or len(MARK.findall(item)) > 1:
                return False
            return bool(SIGN.search(text, max(0, end - LONGEST_ADDRESS), start + LONGEST_ADDRESS))
        return kind > 1 and len(digits_of(item)) < 20 and bool(NUMBER.fullmatch(item))

    regions: list[list] = []  # kind, start, end, parts
    for kind, start, end in sorted(parts):
        if not possible(kind, start, end):
            continue
        if regions and regions[-1][0] == kind and start <= regions[-1][2]:
            regions[-1][2] = max(end, regions[-1][2])
            regions[-1][3].append((start, end))
        else:
            regions.append([kind, start, end, [(start, end)]])
    out: dict[Span, int] = {}
    for kind, start, end, own in regions:
        margin = WIDTH
        while possible(kind, start, end):
            low, high = max(0, start - margin), min(len(text), end + margin)
            tags = model.decode(symbols(text[low:high])[None, :])[0]
            grown = (start, end)
            for begin in np.flatnonzero(tags == 2 * kind + 1).tolist():
                stop = begin + 1
                while stop < len(tags) and tags[stop] == 2 * kind + 2:
                    stop += 1
                first, last = low + begin, low + stop
                if last <= start or end <= first:
                    continue
                if begin == 0 and low > 0 or stop == len(tags) and high < len(text):
                    grown = (min(first, grown[0]), max(last, grown[1]))
                elif last - first > STEP and admitted(kind, text, first, last):
                    out[kind, first, last] = sum(first <= a and b <= last for a, b in own) or 1
            if grown == (start, end):
                break
            (start, end), margin = grown, 2 * margin
    return out


def tagged_spans(texts: list[str], model: Tagger, at_once: int = 512) -> list[dict[Span, int]]:
    """Admitted spans of each text by the number of windows that decode to them."""
    places: list[tuple[int, int]] = []
    for i, text in enumerate(texts):
        starts: set[int] = set()
        for found in ANCHOR.finditer(text):
            low = max(0, -(-(found.start() - WIDTH + 1) // STEP))
            starts.update(range(low, (found.end() - 1) // STEP + 1))
        places += [(i, s * STEP) for s in sorted(starts)]
    out: list[dict[Span, int]] = [{} for _ in texts]
    parts: list[list[Span]] = [[] for _ in texts]  # spans that a window's edge cuts
    for at in range(0, len(places), at_once):
        chunk = places[at : at + at_once]
        ids = np.full((len(chunk), WIDTH), 95, np.uint8)
        for row, (i, start) in enumerate(chunk):
            own = symbols(texts[i][start : start + WIDTH])
            ids[row, : len(own)] = own
        tags = model.decode(ids)
        rows, begins = np.nonzero(tags % 2)
        for row, begin in zip(rows.tolist(), begins.tolist(), strict=True):
            i, start = chunk[row]
            kind = int(tags[row, begin]) // 2
            end = begin + 1
            while end < WIDTH and tags[row, end] == 2 * kind + 2:
                end += 1
            text = texts[i]
            cut = begin == 0 and start > 0 or end == WIDTH and start + WIDTH < len(text)
            first, last = start + begin, min(start + end, len(text))
            if cut:
                parts[i].append((kind, first, last))
            elif last > first and admitted(kind, text, first, last):
                span = (kind, first, last)
                out[i][span] = out[i].get(span, 0) + 1
    for text, own, votes in zip(texts, parts, out, strict=True):
        for span, n in whole_spans(text, own, model).items():
            votes[span] = votes.get(span, 0) + n
    return out


def find_pii(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and those that the tagger adds."""
    base = [base_spans(t) if "@" in t or any(d in t for d in string.digits) else [] for t in texts]
    return [
        (own, reconciled(votes, own)) for own, votes in zip(base, tagged_spans(texts, model), strict=True)
    ]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for k, start, end in sorted(spans))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping ones by the first's."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None
) -> DataFrame:
    """Spans of personal data: one row per row of ``docs``.

    Columns: the id, counts of the base spans by kind, ``base_sha256`` over them,
    ``spans`` (base and added ones) and ``n_added``. A null or empty text has none.
    Repeated rows each get the same result. Without a model one is trained here.
    """
    sent = shared(docs.sparkSession, model or fit_tagger(docs, id_col, text_col))

    def start():
        tagger = sent()

        def kernel(texts):
            found = find_pii(texts, tagger)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            return [*counts, digests, [joined(b + a) for b, a in found], [len(a) for _, a in found]]

        return kernel

    fields = [
        *(T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_added", T.LongType()),
    ]
    return per_text(docs, [id_col], text_col, start, fields)


def redacted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None
) -> DataFrame:
    """All rows of ``docs`` with every span masked by its kind, and an ``n_chars`` that fits.

    Other columns are unchanged; a null text stays null.
    """
    sent = shared(docs.sparkSession, model or fit_tagger(docs, id_col, text_col))

    def start():
        tagger = sent()

        def kernel(texts):
            found = find_pii(texts, tagger)
            return [[masked(t, base + added) for t, (base, added) in zip(texts, found, strict=True)]]

        return kernel

    names = docs.columns
    out = per_text(docs, names, text_col, start, [T.StructField("masked", T.StringType())])
    plain = out.toDF(*(f"c{i}" for i in range(len(names))), "masked")

    def value(i: int, name: str):
        own = F.col(f"c{i}")
        if name == text_col:
            return F.when(own.isNull(), own).otherwise(F.col("masked"))
        if name == "n_chars":
            changed = F.col("masked") != F.col(f"c{names.index(text_col)}")
            return F.when(changed, F.length("masked").cast(docs.schema[name].dataType)).otherwise(own)
        return own

    return plain.select(*(value(i, name).alias(name) for i, name in enumerate(names)))
