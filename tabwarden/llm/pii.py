"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The field's features are word shapes of a token and its neighbours; it is trained on the small labelled table below and
decoded over whole texts by Viterbi in numpy batches. Tokens that no span of the best path can hold, which a bound on the worth
of spans proves, are left out of Viterbi. All rows are handled where they lie, with no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

KINDS = ("email", "ip", "card", "phone")

# --- patterns: fixed values ---
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, which takes linear time where a run of local characters has none."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        end = None
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            free = end
        at = text.find("@", at + 1 if end is None else end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the patterns' matches that pass their tests, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# --- labelled table: [kind text] marks a span; fixed values ---
LABELLED = """\
Call me at [phone (555) 123-4567] tomorrow.
My phone is [phone 555-123-4567], thanks.
tel: [phone 020 7946 0018]
Phone [phone 555.867.5309] or write.
You can reach us on [phone 0171 4567 890] by day.
Fax: [phone (030) 1234-5678].
mobile [phone 07700 900 123] please call
Telefon: [phone 089 123 4567]
tél. [phone 01 23 45 67 89]
phone number [phone 800-555-0199] ext
ring [phone (212) 555-0147] now
call [phone 415 555 2671]
write to [email john at example dot com] today
email: [email mary.smith (at) mail.example.org]
mail [email bob [at] host dot net] please
contact [email info AT company DOT org].
e-mail [email anna dot b at post dot de]
email [email sales(at)shop.example.com]
card [card 4111.1111.1111.1111] was charged
Visa [card 4012_8888_8888_1881] expires soon
card number: [card 5500.0000.0000.0004]
pay with [card 3782.822463.10005] today
server [ip 10 . 0 . 0 . 1] is down
host [ip 192[.]168[.]1[.]7] was seen
address [ip 8[.]8[.]4[.]4] resolved
blocked [ip 172[.]16[.]254[.]3] again
In 1984 there were 120 people on 14 ships.
The price is 12.50 or 1,200 for 3 items.
Version 2.10.3 came out on 2021-04-17.
See pages 120-125 of volume 7.
On 12/05/2019 at 10:30 we met 25 guests.
It is 3 dot points and 5 dots long.
Meet at 5 pm at the dot on the map.
Score 10-2, then 3-1 and 21-19 at home.
Order 123456 has 2 parts of 450 g.
ISBN 978-3-16-148410-0 is a book.
Total 1 234 567 units in 2020 2021 2022.
token = 24be64439e3e49cf46b2d7c90f3602a3
Room 101, floor 3, building 7.
The ratio 0.25 to 0.75 at 20 degrees.
id 00012345 row 77 column 12
a @ b and c @ d with 5 @ 10
Section 4.1.2 and 4.1.3 of part 9
1 2 3 4 5 6 7 8 9 10
100 200 300 400 500 600
at 10 at 20 at 30 the rate is 4
| 12 | 34 | 56 | 78 | 90 |
dot dot dot and at at at 7
write to [email johnny at example.com] soon
email: [email jane at example.com]
mail [email kim AT company.org] now
contact [email mary AT company.org].
send it to [email paul at host.net], please
reach me by email: [email j.doe at mail.example.org]
e-mail [email anna.b (at) post.de] or call
My email is [email tom_r at firm dot com].
contact: [email sales [at] shop [dot] example [dot] com]
mail to [email lee {at} site {dot} io]
email [email max @ example . com] for more
write [email eva at uni dot edu]
Reach us: [phone (089) 765 4321] or [phone 089-765-4322].
Call [phone 212.555.0199] or mail [email bo at example dot org].
my number is [phone 0151 2345 6789], call me
phone: [phone (415) 555-0100]
Tel. [phone 0043 1 234 5678]
call [phone 01-234-5678] now
ip [ip 10[.]20[.]30[.]40] was blocked
from host [ip 192 . 168 . 0 . 12] to host [ip 192 . 168 . 0 . 13]
address [ip 172[.]31[.]0[.]9], blocked
pay by card [card 5105.1051.0510.5100] only
my visa is [card 4222_2222_2222_2220].
card [card 6011/1111/1111/1117] on file
We met at the house. It was late.
They look at it and see the dot.
The show is at home. Come at 8 or at 9.
It is found at example.com and on the page.
See more at www.example.org today.
available at shop.example.com since 2019
visit the site at news.example.net
Look at this.The end came.
at. at, at the end of the page at night.
He was at school. She was at work.
A dot and a dot and at last a dot.
On 2021-04-17 at 10:30 in room 5.
Tables 1, 2, 3 and 4: 10 20 30 40.
The sum of 12 345 678 and 9 is 12 345 687.
From 1999 to 2005 there were 300 to 400 of them.
Pages 10-20, 30-40 and 50-60 of the order.
1.2.3 is the version and 4.5.6 is next.
The number 1234567 was drawn.
Item 55-1234 costs 12.99 or 13.99.
It rose by 3.5 to 4.5 in 1980-1990.
Ratios: 1/2, 3/4, 5/8 and 7/16.
The key is 8f3a9c2dee1177ab and so on.
Lorem at ipsum dolor. Sit amet at elit.
abc def ghi at jkl mno. Pqr stu.
WE SAW IT AT NIGHT. IT WAS DARK.
x y z 1 a 2 b 3 c
Values: 3 14 15 92 65 35 and 89.
Counts 21 22 23 24 1990 1991
Sums: 4.25 7,300 31 32 33 1980 1981
The years 1901 1902 1903 were cold.
Numbers: 11 12 13 14 15 16 17.
"""

#: Words that are features as they are; all others are features by their shape.
WORDS = (
    "at dot com net org de io edu phone tel telefon tél mobile call fax ring reach email mail e write contact send card visa charge pay number server host address ip "
    "blocked version isbn order page pages section room look meet found available see visit site is was in on the of and or to"
).split()
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Passes of training, step and weight decay.
EPOCHS, STEP, DECAY = 150, 0.5, 1e-3
#: Bytes of text whose tokens are held at once, and tokens of a batch of Viterbi.
TOGETHER, BATCH = 400_000, 50_000

#: Shapes: 0 for marks that the table does not have, 1 around texts, digits by number, letters by case and whether there is one only, then words and marks.
EDGE, DIGITS, CASES, FIRST_WORD = 1, 1, 11, 17
U = np.uint64
POWERS = np.cumprod(np.full(32, 0x9E3779B97F4A7C15, U)) | U(1)


@cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its kind (0 space, 1 letter, 2 digit 0 to 9, 3 other; 4 more where upper case), and its lower case."""
    kind, low = np.full(0x110000, 3, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            kind[i] = 0
        elif c.isalpha():
            kind[i] = 5 if c.isupper() else 1
            if len(c.lower()) == 1:
                low[i] = ord(c.lower())
    kind[48:58] = 2
    return kind, low


def hashed(words: list[str]) -> np.ndarray:
    return np.array([int((np.array([ord(c) for c in w], U) * POWERS[: len(w)]).sum()) for w in words], U)


def tokens_of(texts: list[str], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shape, space before, text, start and end of each token of all texts, with three edges around each text.

    Tokens are runs of letters, runs of digits, and all other characters but white space, one by one. marks: code points of the table's marks, sorted.
    """
    kinds, low = alphabet()
    text_size = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.cumsum(text_size) - text_size
    full = kinds[codes]
    kind = full & 3
    new = np.ones(len(codes), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    new[base[text_size > 0]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(codes))
    live = kind[start] > 0
    owner_all = np.repeat(np.arange(len(texts)), text_size)
    space = np.ones(len(start), bool)  # white space before, or the beginning of the text
    space[1:] = ~live[:-1]
    owner = owner_all[start] if len(start) else np.zeros(0, np.int64)
    space[1:] |= owner[1:] != owner[:-1]
    upper = np.concatenate([[0], np.cumsum(full == 5)])
    place = np.arange(len(codes)) - np.repeat(start, end - start)
    part = np.where(place < len(POWERS), low[codes].astype(U) * POWERS[np.minimum(place, len(POWERS) - 1)], U(0))
    word = np.add.reduceat(part, start) if len(start) else np.zeros(0, U)
    start, end, space, owner, word = start[live], end[live], space[live], owner[live], word[live]
    own, size = kind[start] if len(start) else np.zeros(0, np.uint8), end - start
    first, many = full[start] == 5 if len(start) else np.zeros(0, bool), upper[end] - upper[start]
    shape = np.zeros(len(start), np.int64)
    digits, letters, other = own == 2, own == 1, own == 3
    shape[digits] = DIGITS + np.minimum(size[digits], 9)
    shape[letters] = (CASES + np.where(many == size, 0, np.where(first, 2, 4)) + (size == 1))[letters]
    names = np.sort(hashed(WORDS))
    order = np.argsort(hashed(WORDS))
    at = np.minimum(np.searchsorted(names, word), len(names) - 1)
    known = letters & (names[at] == word) & (size <= max(map(len, WORDS)))
    shape[known] = FIRST_WORD + order[at[known]]
    if len(marks):
        code = codes[start]
        at = np.minimum(np.searchsorted(marks, code), len(marks) - 1)
        known = other & (marks[at] == code)
        shape[known] = FIRST_WORD + len(WORDS) + at[known]
    # Three edges before the first text and behind each.
    seat = np.arange(len(start)) + 3 * (owner + 1)
    n = len(start) + 3 * (len(texts) + 1)
    out = [np.full(n, EDGE), np.ones(n, bool), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for to, values in zip(out, (shape, space, owner, start - base[owner], end - base[owner])):
        to[seat] = values
    return tuple(out)


#: Templates of features: places relative to the token, and whether white space before the second of two neighbours counts.
TEMPLATES = (
    ((0,), 0), ((-1,), 1), ((1,), 2), ((-2,), 0), ((2,), 0), ((-1, 0), 1), ((0, 1), 2), ((-2, -1, 0), 0), ((0, 1, 2), 0), ((-1, 1), 0), ((-3,), 0), ((3,), 0),
)


def windows(shape: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct surroundings of tokens, seven shapes and two spaces in one number, and which each token has."""
    wide = np.concatenate([np.full(3, EDGE), shape, np.full(3, EDGE)]).astype(np.int64)
    after = np.append(space[1:], True)
    key = space.astype(np.int64) + 2 * after
    for j in range(7):
        key += wide[j : j + len(shape)] << (2 + 8 * j)
    coded = pa.array(key).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)


def features(window: np.ndarray) -> np.ndarray:
    """(windows, templates): a number for each feature."""
    at = lambda j: (window >> (2 + 8 * (j + 3))) & 255
    out = np.empty((len(window), len(TEMPLATES)), np.int64)
    for t, (places, gap) in enumerate(TEMPLATES):
        key = np.full(len(window), t, np.int64)
        for j in places:
            key = key * 256 + at(j)
        out[:, t] = key * 4 + (window & 1 if gap == 1 else (window >> 1) & 1 if gap == 2 else 2)
    return out


def labelled() -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """The table's texts, and (start, end, kind) of each one's marked spans."""
    texts, marks = [], []
    for line in LABELLED.splitlines():
        text, own, at = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[[^\]]*\])*)\]", line):
            text += line[at : m.start()]
            own.append((len(text), len(text) + len(m[2]), KINDS.index(m[1])))
            text += m[2]
            at = m.end()
        texts.append(text + line[at:])
        marks.append(own)
    return texts, marks


def allowed() -> np.ndarray:
    """Transitions: 0, or minus much for an I that does not follow its kind."""
    t = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            t[[i for i, a in enumerate(LABELS) if a[2:] != b[2:] or a == "O"], j] = -1e4
    return t


class Field:
    """Weights by feature and label, and of label pairs; trained by full-batch gradient steps from zero. Texts begin and end in O."""

    def __init__(self):
        texts, spans = labelled()
        self.marks = np.array(sorted({ord(c) for t in texts for c in t if not c.isalnum() and not c.isspace()}), np.uint32)
        shape, space, owner, start, _ = tokens_of(texts, self.marks)
        window, of = windows(shape, space)
        found = features(window)
        self.known, number = np.unique(found, return_inverse=True)
        number = number.reshape(found.shape)
        rows = []
        for n, own in enumerate(spans):
            mine = np.flatnonzero(owner == n)
            tags = []
            for a in start[mine].tolist():
                hit = next(((x, k) for x, y, k in own if x <= a < y), None)
                tags.append(0 if hit is None else 1 + 2 * hit[1] + (hit[0] != a))
            rows.append((number[of[mine]], np.array(tags)))
        k, hard = len(LABELS), allowed()
        w, t = np.zeros((len(self.known), k)), np.zeros((k, k))
        gw2, gt2 = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
        for _ in range(EPOCHS):
            gw, gt = -DECAY * w, -DECAY * t
            trans = t + hard
            for feats, tags in rows:
                n = len(tags)
                e = w[feats].sum(axis=1)
                alpha, beta = np.zeros((n, k)), np.zeros((n, k))
                alpha[0], beta[-1] = e[0] + trans[0], trans[:, 0]
                for i in range(1, n):
                    alpha[i] = np.logaddexp.reduce(alpha[i - 1][:, None] + trans, axis=0) + e[i]
                for i in range(n - 2, -1, -1):
                    beta[i] = np.logaddexp.reduce(trans + (e[i + 1] + beta[i + 1])[None], axis=1)
                z = np.logaddexp.reduce(alpha[-1] + trans[:, 0])
                p = -np.exp(alpha + beta - z)
                gt[0] += p[0]
                gt[:, 0] += p[-1]
                p[np.arange(n), tags] += 1
                gt[0, tags[0]] += 1
                gt[tags[-1], 0] += 1
                for c in range(feats.shape[1]):
                    np.add.at(gw, feats[:, c], p)
                for i in range(1, n):
                    gt -= np.exp(alpha[i - 1][:, None] + trans + (e[i] + beta[i])[None] - z)
                    gt[tags[i - 1], tags[i]] += 1
            gw2 += gw**2
            gt2 += gt**2
            w += STEP * gw / np.sqrt(gw2)
            t += STEP * gt / np.sqrt(gt2)
        self.weights, self.trans = np.vstack([w, np.zeros(k)]), t + hard
        spans_of = [(1 + 2 * j, 2 + 2 * j) for j in range(len(KINDS))]
        soft = np.where(self.trans < -1e3, -np.inf, self.trans)
        #: What a token more, and the ends, can bring a span beyond what O brings there.
        self.inside = max(max(soft[b, i], soft[i, i]) for b, i in spans_of) - soft[0, 0]
        begins = [b for b, _ in spans_of]
        self.ends = (soft[:, begins] - soft[:, :1]).max() + max((soft[x, [0, *begins]] - soft[0, [0, *begins]]).max() for pair in spans_of for x in pair)

    def emissions(self, window: np.ndarray) -> np.ndarray:
        """(windows, labels): summed weights of the features that the table has."""
        found = features(window)
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        return self.weights[np.where(self.known[at] == found, at, len(self.known))].sum(axis=1)

    def undecided(self, gain: np.ndarray) -> np.ndarray:
        """Tokens that some span might hold; all others are O on the best path, whatever the rest is.

        gain: how far a token's best other label is above O. A span's worth is at most the sum over its tokens of gain and `inside`, and
        `ends`. Where the best sum over all spans that hold a token stays below 0, O throughout the span would be better.
        """
        g = gain + self.inside
        s = np.concatenate([[0.0], np.cumsum(g)])
        left = s[:-1] - np.minimum.accumulate(s[:-1])  # the best sum of tokens that end just before
        right = np.maximum.accumulate(s[::-1])[::-1][1:] - s[1:]
        return g + left + right + self.ends - self.inside >= -1e-3

    def paths(self, e: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Labels of all tokens by Viterbi over the stretches [first, last), each between two O, batches of like length at a time."""
        out, size = np.zeros(len(e), np.int8), last - first
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            shortest, stop = size[order[at]], at + 1
            while stop < len(order) and size[order[stop]] <= 1.25 * shortest + 4 and (stop + 1 - at) * size[order[stop]] <= BATCH:
                stop += 1
            group = order[at:stop]
            at, top = stop, int(size[group].max())
            inside = np.arange(top)[None] < size[group][:, None]
            place = np.where(inside, first[group][:, None] + np.arange(top)[None], 0)
            x = np.where(inside[:, :, None], e[place], np.where(np.arange(len(LABELS)) == 0, 0.0, -1e6))  # padding is O
            back = np.zeros((len(group), top, len(LABELS)), np.int8)
            v = x[:, 0] + self.trans[0]
            for i in range(1, top):
                through = v[:, :, None] + self.trans
                back[:, i] = through.argmax(axis=1)
                v = through.max(axis=1) + x[:, i]
            path, rows = np.zeros((len(group), top), np.int8), np.arange(len(group))
            path[:, -1] = (v + self.trans[:, 0]).argmax(axis=1)
            for i in range(top - 1, 0, -1):
                path[:, i - 1] = back[rows, i, path[:, i]]
            out[place[inside]] = path[inside]
        return out

    def spans(self, texts: list[str], whole: bool = False) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of each text's spans on the best path over the whole text. `whole` decodes decided tokens too, which changes nothing."""
        shape, space, owner, start, end = tokens_of(texts, self.marks)
        window, of = windows(shape, space)
        scores = self.emissions(window)
        gain = (scores[:, 1:].max(axis=1) - scores[:, 0])[of]
        gain[owner < 0] = -1e6
        live = (owner >= 0) if whole else self.undecided(gain) & (owner >= 0)
        edge = np.diff(np.concatenate([[0], live.astype(np.int8), [0]]))
        label = self.paths(scores[of], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        begins = np.flatnonzero(label % 2 == 1)
        more = np.append(label[1:], 0)
        stops = np.flatnonzero((label > 0) & ~((more > 0) & (more % 2 == 0)))
        for b, s in zip(begins.tolist(), stops.tolist(), strict=True):
            out[owner[b]].append(((int(label[b]) - 1) // 2, int(start[b]), int(end[s])))
        return out


@cache
def field() -> Field:
    return Field()


#: An address that is spelled out: parts of a name, `at` or @, parts of a host with a dot or `dot` between them.
SPELLED = re.compile(
    r"[\w+-]+(?:\s*(?:\.|\bdot\b)\s*[\w+-]+){0,4}\s*[(\[{<]?\s*(?:@|\bat\b)\s*[)\]}>]?\s*[\w-]+(?:\s*[(\[{]?\s*(?:\.|\bdot\b)\s*[)\]}]?\s*[\w-]+){1,5}", re.IGNORECASE,
)
#: What a phone number without its plus is made of.
PHONE_LIKE = re.compile(r"\(?[0-9][0-9()./ -]*[0-9]")
#: The longest span of each kind, in characters.
LONGEST = (100, 50, 40, 30)


def plausible(kind: int, found: str) -> bool:
    """A check on what the field finds, as the patterns have theirs."""
    if len(found) > LONGEST[kind]:
        return False
    d = digits_of(found)
    if kind == 0:
        return SPELLED.fullmatch(found) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and max(map(len, parts)) <= 3 and all(int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15 and PHONE_LIKE.fullmatch(found) is not None


def find_all(texts: list[str], model: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text: base spans, and the field's spans that touch none of them."""
    out = []
    for text, known, new in zip(texts, map(base_spans, texts), model.spans(texts)):
        taken = sorted((a, b) for _, a, b in known)
        starts = np.array([a for a, _ in taken])
        ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
        free = []
        for k, a, b in new:
            at = int(np.searchsorted(starts, b))
            if (not at or ends[at - 1] <= a) and plausible(k, text[a:b]):
                free.append((k, a, b))
        out.append((known, free))
    return out


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


SPANS = "doc_id long, base string, spans string, n_email long, n_ip long, n_card long, n_phone long, n_added long, redacted string"


def find_pii(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", redact: bool = False, carry: list[str] | None = None, keep_null: bool = False
) -> DataFrame:
    """One row per input row: doc_id, base and all spans as text, counts of base spans by kind, n_added, redacted text.

    Offsets count code points, end exclusive. A null text counts as empty. `redacted` has each span replaced by its
    kind in brackets where `redact` is set (overlapping spans as one, by the first's kind), and is null otherwise; with
    `keep_null` a null text is redacted to null. Null ids and repeated rows are rows like others; the columns of `carry`
    follow behind, unchanged, and other columns are ignored.
    """
    model = field()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", TOGETHER):
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = find_all(texts, model)
            out: dict[str, list] = {"base": [said(b) for b, _ in found], "spans": [said(b + m) for b, m in found]}
            for k, name in enumerate(KINDS):
                out[f"n_{name}"] = [sum(s[0] == k for s in b) for b, _ in found]
            out["n_added"] = [len(m) for _, m in found]
            gone = part.column(1).is_null().to_pylist() if keep_null else [False] * len(texts)
            out["redacted"] = [redacted(t, b + m) if redact and not g else None for t, (b, m), g in zip(texts, found, gone)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(out[n], pa.string() if n in ("base", "spans", "redacted") else pa.int64()) for n in out], *part.columns[2:]],
                ["doc_id", *out, *carry],
            )

    carry = carry or []
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    return map_batches(rows, work, ", ".join([SPANS, *(f"`{c}` {dict(df.dtypes)[c]}" for c in carry)]))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
