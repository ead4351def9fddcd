"""Plain versions of the operators, and a table of awkward documents."""

import hashlib
import random
import re
from collections import Counter

import xxhash

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, words string, h long"


def sentence(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def documents():
    """Nulls, empty and long texts, repeated rows and keys, near copies, columns with names used inside."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in (0, 60, 119)]
    texts = [None, "", "  \n\t ", "one", "One two three", base, base, base.upper(), *near, sentence(rng, 9000), "ÀÉ Ünï ÀÉ x\x1cy", "a\n\nb\na\nb \n" * 3,
             "w1 w2 w3 w4 w5 " * 7, "!!! ### $$$ % & | <> *", sentence(rng, 40), sentence(rng, 41)]
    rows = [(i, t, "en" if i % 3 else None, "src0", 0, 7, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], (None, "keyless text here", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "another text of three", "fr", "s", 1, 1, "", 0)]
    return rows


def fingerprint(text):
    words = re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def groups(fps, distance=4):
    """fingerprint -> a number of its component."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def near_duplicates(rows):
    fp = [fingerprint(r[1]) for r in rows]
    of = groups(fp)
    smallest = {}
    for r, f in zip(rows, fp):
        if r[0] is not None:
            smallest[of[f]] = min(smallest.get(of[f], r[0]), r[0])
    return [(r[0], f"{f:016x}", smallest.get(of[f])) for r, f in zip(rows, fp)]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items):
    windows = {}
    for i, t in items:
        w = item_words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for key, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    found |= windows[tuple(w[j : j + n])]
                    hit.update(range(j, j + n))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def measures(text):
    text = text or ""
    w = re.findall(r"[^ \t-\r]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def _turns(left, right, a, b, key, tweak):
    def keyed(i, half):
        return int(hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)

    for i in range(8):
        if i % 2 == 0:
            left = (left + keyed(i, right)) % a
        else:
            right = (right + keyed(i, left)) % b
    return left, right


def _permuted(s, alphabet, key, tweak):
    n, out = len(alphabet), ""

    def number(part):
        return sum(alphabet.index(c) * n**i for i, c in enumerate(reversed(part)))

    def text(x, size):
        return "".join(alphabet[x // n**i % n] for i in reversed(range(size)))

    for j in range(0, len(s), 16):
        part = s[j : j + 16]
        k = len(part) // 2
        left, right = _turns(number(part[:k]), number(part[k:]), n**k, n ** (len(part) - k), key, f"{tweak}|{j // 16}|{len(part)}")
        out += text(left, k) + text(right, len(part) - k)
    return out


DIGITS, SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def _put(value, among, fresh):
    fresh = iter(fresh)
    out = [next(fresh) if c in among else c for c in value]
    return "".join(n.upper() if c.isascii() and c.isupper() else n for c, n in zip(value, out))


def _number(value, key, kind):
    return _put(value, DIGITS, _permuted("".join(c for c in value if c in DIGITS), DIGITS, key, kind))


def _letters_and_digits(value, key, tweak):
    letters = _permuted("".join(c.lower() for c in value if c.lower() in SMALL), SMALL, key, tweak)
    return _number(_put(value, SMALL + SMALL.upper(), letters), key, tweak)


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def _mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def pseudonym(v, kind, key):
    import datetime

    if kind == "email":
        local, domain = v.split("@")
        return _letters_and_digits(local, key, "email|" + domain.lower()) + "@" + domain
    if kind == "ip":
        a, b, c, d = map(int, v.split("."))
        x, y = _turns(a * 256 + b, c * 256 + d, 65536, 65536, key, "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "date":
        sep = next(c for c in v if c in "-/.")
        parts = v.split(sep)
        full = [len(x) for x in parts] in ([4, 2, 2], [2, 2, 4])
        for order in {"-": ["ymd"], "/": ["dmy", "mdy"], ".": ["dmy"]}[sep]:
            try:
                day = datetime.date(*(int(parts[order.index(x)]) for x in "ymd"))
            except ValueError:
                continue
            n = (day - datetime.date(1800, 1, 1)).days
            if not 0 <= n < 189 * 773:
                return v
            x, y = _turns(n // 773, n % 773, 189, 773, key, "date")
            new = datetime.date(1800, 1, 1) + datetime.timedelta(x * 773 + y)
            two = (lambda k: f"{k:02d}") if full else str
            return sep.join({"y": str(new.year), "m": two(new.month), "d": two(new.day)}[x] for x in order)
        return v
    if kind == "iban":
        s = v.replace(" ", "")
        if _mod97(s[4:] + s[:4]) != 1:
            return v
        bban = s[4:]
        bban = _number(bban, key, "iban|" + re.sub("[0-9]", "#", bban))
        new = iter(f"{s[:2]}{98 - _mod97(bban + s[:2] + '00'):02d}{bban}")
        return "".join(c if c == " " else next(new) for c in v)
    if kind == "card":
        digits = "".join(c for c in v if c in DIGITS)
        if _luhn(digits):
            return v
        body = _permuted(digits[:-1], DIGITS, key, "card")
        return _put(v, DIGITS, body + next(c for c in DIGITS if not _luhn(body + c)))
    if kind == "phone":
        head = re.match(r"\+(?:1|[0-9]{1,3}(?=[ .(-])|)|", v)[0]
        return head + _number(v[len(head) :], key, "phone")
    if kind == "key":
        return "AKIA" + _permuted(v[4:], DIGITS + SMALL.upper(), key, "key")
    if kind == "token":
        return v[:8] + _letters_and_digits(v[8:], key, "token|" + v[:8])
    if kind == "secret":
        head = re.sub("[0-9a-f]+$", "", v)
        return head + _permuted(v[len(head) :], "0123456789abcdef", key, "secret")
    return _number(v, key, kind)


def pseudonymise(text, key):
    """(text with pseudonyms, number of values changed), value by value from left to right."""
    from corpusloom.llm import pii  # the patterns are the formats; what is done with a value is written out here

    if text is None:
        return None, 0
    kinds = {k: re.compile(p, re.ASCII) for k, p in pii.PATTERNS.items()}
    changed = 0

    def put(m):
        nonlocal changed
        kind = next(k for k, p in kinds.items() if p.fullmatch(m[0]))
        new = pseudonym(m[0], kind, key)
        changed += new != m[0]
        return new

    return re.sub(pii.ANY, put, text, flags=re.ASCII), changed


def article_blocks(page):
    """Blocks of the one article of a page, by the standard library's parser; parts that markup names as something else are left out."""
    from html.parser import HTMLParser

    inline = set("a b i em strong span code sup sub small u s mark abbr cite q time label font".split())

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.article, self.skip, self.blocks, self.parts = 0, [], [], []

        def end_block(self):
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(text)
            self.parts = []

        def handle_starttag(self, tag, attributes):
            if tag == "br":
                self.parts.append(" ")
            elif tag not in inline:
                self.end_block()
            names = {x for k, v in attributes if k in ("class", "id") for x in (v or "").split()}
            if tag == "article":
                self.article += 1
            elif self.skip and tag == self.skip[0]:
                self.skip.append(tag)
            elif not self.skip and (tag in ("nav", "aside", "footer", "form", "script", "style") or names & {"ad", "comments", "notice", "sidebar", "cookie", "related", "share"}):
                self.skip.append(tag)

        def handle_endtag(self, tag):
            if tag not in inline:
                self.end_block()
            if tag == "article":
                self.article -= 1
            elif self.skip and tag == self.skip[0]:
                self.skip.pop()

        def handle_data(self, data):
            if self.article and not self.skip:
                self.parts.append(data)

    parser = Parser()
    parser.feed(page)
    parser.close()
    parser.end_block()
    return parser.blocks


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
