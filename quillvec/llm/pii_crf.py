"""Personal data found by a skip-chain conditional random field.

Tokens are runs of non-blank characters, cut further at marks such as ``: , ; = " ' < > ( ) { } | [ ]`` (and ``/ & ? #``
where the run holds "@" or "://"), so that each address or number glued to other text is a token of its own; the marks of amounts,
times, ports, area codes, IPv6 addresses and a URL's user are not cut at. A cut parts tokens as a word between them would. A token without a digit and without "@" can't be personal data here: its label is
clamped to "O". The others are nodes with a label each (O, EMAIL, PHONE, CARD, IP, SSN, IBAN, SECRET: a key of a known form or a word glued to "password="). Unary potentials come from
the token's shape, checksums and neighbouring words; chain potentials join nodes that stand next to each other (a clamped
neighbour contributes its "O"); skip potentials join each token to the next one in the document that repeats it or has
the same digits, however far away. Loopy belief propagation passes messages along both kinds of edges, over the whole
document, so that an entity recognised in one place is recognised where its context says less. The weights are fitted here
by penalised pseudo-likelihood on sentences that ``training_documents`` makes up; no text of the corpus is used.

Neighbouring tokens with the same label form an entity (so do the groups of one IBAN, known by its checksum, with the
bank's letters among them), and ``[LABEL]`` replaces it in the text.

Defined cases: null and empty texts have no entities and are returned as they are. Repeated rows give equal results, and
ties of belief go to the first label, "O" before others. An empty table gives an empty result; doc_id may be of any type.
``redact`` keeps the columns of its input whatever their names. Texts of any length are read whole, in time proportional to
their length; a piece of more than ``LONGEST`` characters, longer than any address may be, has no features but its length.
"""

from __future__ import annotations

import functools
import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm import textbytes as tb
from quillvec.llm.columns import kind, plain, restored

LABELS = ["O", "EMAIL", "PHONE", "CARD", "IP", "SSN", "IBAN", "SECRET"]
K, ROUNDS, DAMPING, LONGEST = len(LABELS), 12, 0.3, 320
BLANKS = np.ones(256, bool)
BLANKS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
EVIDENCE = np.zeros(256, bool)
EVIDENCE[[*range(48, 58), 64]] = True

STRIP = ".,;:!?\"'`<>[]{}#$%&*|=~_/\\^"
SEPARATOR = re.compile(r"[:,;=\"'<>(){}|\[\]\\`]")
WITH_SLASH = re.compile(SEPARATOR.pattern[:-1] + "&?/#]")
KEPT = re.compile(r"\(\d{2,4}\)(?=[\d.\-/]|$)|(?<![\d.,])\d{1,3}(?:,\d{3})+(?![\d\-])|(?<![\d:])\d\d?:\d\d(?::\d\d)?(?![\d:])|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5}|/\d\d?)(?![\d.])|(?<=://)[^/\s@]+@")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{0,4})(?:/\d{1,3})?(?![\w:])")
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 4, 5)}
IBAN_HEAD, IBAN_GROUP = re.compile(r"^[A-Z]{2}\d{2}$"), re.compile(r"^[A-Z0-9]{1,8}$")
PHONE_HEAD, PHONE_GROUP = re.compile(r"^(?:\+\d{1,3}|\(0\d{1,4}\)|0\d{1,4})$"), re.compile(r"^(?:\d{1,8}|\(\d{1,4}\))$")
EMAIL = re.compile(r"(?i)^(?:mailto:)?[\w.+\-%]+@[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2,}$")
IP4 = re.compile(r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?::\d{1,5}|/\d{1,2})?$")
CONTEXT = {
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "sms", "dial", "telefon", "teléfono", "téléphone"},
    "mail": {"email", "e-mail", "mail", "contact", "write", "mailto", "correo", "courriel"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "cc", "karte", "tarjeta", "carte"},
    "ip": {"ip", "host", "server", "address", "addr", "from", "client", "adresse"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "konto", "cuenta", "compte", "bank"},
    "secret": {"password", "passwd", "pwd", "passphrase", "secret"},
    "version": {"version", "v", "release", "ver", "chapter", "section", "fig", "page", "kapitel"},
    "amount": {"order", "id", "nr", "number", "item", "invoice", "total", "price", "usd", "eur", "$", "€", "count", "ref", "isbn", "rechnung", "factura", "facture", "tracking", "serial"},
    "time": {"year", "in", "since", "until", "no", "of"},
}
_CONTEXT = {w: c for c, ws in CONTEXT.items() for w in ws}


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban(core: str) -> bool:
    if not re.match(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$", core):
        return False
    return int("".join(str(int(c, 36)) for c in core[4:] + core[:4])) % 97 == 1


def ip6(core: str) -> bool:
    if core.count(":") < 2 or not IP6.fullmatch(core):
        return False
    try:
        return ipaddress.ip_network(core, False).version == 6
    except ValueError:
        return False


def remembered(f):
    """``f`` of a token, remembered if the token isn't long."""
    kept = functools.lru_cache(1 << 16)(f)
    return functools.wraps(f)(lambda token: kept(token) if len(token) <= 64 else f(token))


@remembered
def shape(core: str) -> tuple[str, ...]:
    """Features of a token, punctuation around it removed."""
    if len(core) > LONGEST:
        return ("too long",)
    digits = re.sub(r"\D", "", core)
    n, letters = len(digits), any(c.isalpha() for c in core)
    f = ["digits=" + ("0" if not n else "1-2" if n < 3 else "3" if n == 3 else "4" if n == 4 else "5-6" if n < 7 else "7" if n == 7 else "8-9" if n < 10 else "10-12" if n < 13 else "13-19" if n < 20 else "20+")]
    f.append("letters" if letters else "no letters")
    if "@" in core:
        f.append("email" if EMAIL.match(core) else "at")
    m = IP4.match(core)
    if ip6(core):
        f.append("ip six")
    elif m:
        f.append("ip" if all(int(x) < 256 for x in m.groups()[:4]) else "four numbers")
    elif re.match(r"^v?\d+(\.\d+)+\w*$", core):
        f.append("dotted")
    if core.isdigit():
        f.append("only digits")
    if 13 <= n <= 19 and re.match(r"^\d+(?:[ \-]\d+)*$", core):
        f += ["card length", "luhn" if luhn(digits) else "no luhn", "card start" if core[0] in "23456" else "other start"]
    if re.match(r"^97[89]-?\d{1,5}-?\d{1,7}-?\d{1,6}-?\d$", core) and n == 13:
        f.append("isbn")
    if re.match(r"^\+\d{1,3}$", core):
        f.append("country code")
    if re.match(r"^\+\d[\d\-.()]{6,}$", core):
        f.append("international")
    if re.match(r"^\(\d{2,4}\)$", core):
        f.append("area code")
    if re.match(r"^\(?\d{3}\)?[\-.]\d{3}[\-.]\d{4}$", core):
        f.append("ten with marks")
    if re.match(r"^\d{3}[\-.]\d{4}$", core):
        f.append("seven with mark")
    if re.match(r"^\d{3}-\d{2}-\d{4}$", core):
        f.append("ssn")
    if re.match(r"^\(?0\d{1,4}(?:[\-/.]|\)[\-/.]?)\d{3,8}([\-/.]\d{2,8})*$|^0\d([.\-]\d\d){4}$", core) and 9 <= n <= 13:
        f.append("national")
    if re.match(r"^(\d{4}-){3}\d{1,7}$", core):
        f.append("card groups")
    if iban(core):
        f.append("iban")
    if re.match(r"^\d{4}-\d\d?-\d\d?$|^\d\d?[./]\d\d?[./]\d{2,4}$", core):
        f.append("date")
    if re.match(r"^\d\d?:\d\d(:\d\d)?$", core):
        f.append("time")
    if re.match(r"^[$€£]?\d{1,3}(,\d{3})*(\.\d+)?%?$", core):
        f.append("amount")
    if re.match(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^(?:sk|pk|rk)_(?:live|test)_\w{16,}$|^gh[opsu]_\w{30,}$", core):
        f.append("key form")
    if letters and n and re.match(r"^[0-9a-fA-F]{20,}$", core):
        f.append("hex")
    return tuple(f)


def core_of(token: str) -> tuple[int, int]:
    """The part of a token that may be an entity, without the marks around it."""
    a, b = 0, len(token)
    while a < b and (token[a] == ":" and token[a + 1 : a + 2] == ":" and IP6.match(token, a) is None or token[a] in STRIP and token[a : a + 2] != "::" or token[a] in "()-" and not (token[a] == "(" and token[a + 1 : a + 2].isdigit())):
        a += 1
    opened = token.rfind("(", a, b)
    while b > a and (token[b - 1] in STRIP and not (token[b - 2 : b] == "::" and IP6.search(token[max(a, b - 48) : b])) or token[b - 1] in "+-" or (token[b - 1] == "(") or (token[b - 1] == ")" and opened < 0)):
        b -= 1
        opened = opened if opened < b else token.rfind("(", a, b)
    return a, b


@remembered
def pieces(token: str) -> tuple[tuple[int, int], ...]:
    """The places of the parts of a token that stand for themselves, without the marks around them; at least one."""
    a, b = core_of(token)
    core = token[a:b]
    marks = WITH_SLASH if "@" in core or "://" in core else SEPARATOR
    if not marks.search(core):
        return ((a, b),)
    kept = {k for m in KEPT.finditer(core) for k in range(*m.span())}
    if core.count(":") > 1:
        kept |= {k for m in IP6.finditer(core) if ip6(m.group()) for k in range(*m.span())}
    cuts = [(m.start(), m.end()) for m in marks.finditer(core) if m.start() not in kept]
    # an area code is cut off from a word before it
    cuts += [(k, k) for k in kept if core[k] == "(" and k and core[k - 1].isalpha()]
    out, at = [], 0
    for start, end in [*sorted(cuts), (len(core), len(core))]:
        low, high = core_of(core[at:start])
        if high > low:
            out.append((a + at + low, a + at + high))
        at = end
    return tuple(out) or ((a, b),)


def is_candidate(piece: str) -> bool:
    return any(c.isdigit() and c.isascii() or c == "@" for c in piece)


def iban_run(i: int, at: list[int], cores: list[str], after: list[str]) -> int:
    """The last node of the grouped IBAN that starts at node i, or i; four letters may stand between two nodes."""
    text, j, last = cores[i], i, i
    while len(text) < 34 and j + 1 < len(at):
        between = after[j] if at[j + 1] == at[j] + 2 and re.match(r"^[A-Z]{4}$", after[j]) else ""
        group = between + cores[j + 1]
        if at[j + 1] != at[j] + 1 + bool(between) or not IBAN_GROUP.match(group):
            break
        text, j = text + group, j + 1
        if iban(text):
            last = j
    return last


def phone_run(i: int, at: list[int], cores: list[str]) -> int:
    """The last node of the number in groups of digits that starts at node i, with a trunk or country code; or i."""
    digits = lambda c: sum(x.isdigit() for x in c)
    least = 10 if cores[i][0] == "+" else 9
    n, j = digits(cores[i]), i
    while n <= least and j + 1 < len(at) and at[j + 1] == at[j] + 1 and PHONE_GROUP.match(cores[j + 1]) and n + digits(cores[j + 1]) <= 14:
        j += 1
        n += digits(cores[j])
    return j if n >= least and j > i else i


def key_of(core: str) -> str | None:
    """Equal keys: the same or a similar token."""
    digits = re.sub(r"\D", "", core)
    if "@" not in core and len(digits) >= 7 and not any(c.isalpha() for c in core):
        return digits + ("." if "." in core and IP4.match(core) else "")
    return core.lower() if len(core) >= 4 else None


def card_run(i: int, at: list[int], cores: list[str]) -> int:
    """The last node of a card number in groups, by its check digit, that starts at node i; or i."""
    sizes, text, last = (), "", i
    for j in range(i, min(i + 5, len(cores))):
        if j > i and at[j] != at[j - 1] + 1 or not cores[j].isdigit() or len(cores[j]) > 6:
            break
        sizes, text = (*sizes, len(cores[j])), text + cores[j]
        if sizes in CARD_GROUPS and text[0] in "3456" and luhn(text):
            last = j
    return last


def ten_run(i: int, at: list[int], cores: list[str]) -> bool:
    """Whether a ten-digit number in groups of three, three and four starts at node i."""
    return i + 2 < len(cores) and at[i + 2] == at[i] + 2 and [len(c) for c in cores[i : i + 3]] == [3, 3, 4] and all(c.isdigit() for c in cores[i : i + 3])


class Nodes:
    """The nodes of some documents: their features and edges."""

    def __init__(self):
        self.features: list[list[str]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.whole: dict[int, int] = {}  # the nodes of a grouped IBAN, and its first one
        self.open: list[tuple[bool, bool]] = []  # a clamped token or the border before, after

    def add(self, at: list[int], cores: list[str], before: list[str], after: list[str]) -> None:
        """One document's candidate tokens at token positions ``at``, with the words around them."""
        first = len(self.features)
        group = ["only digits" in shape(c) and len(c) == 4 for c in cores]
        last: dict[str, int] = {}
        phones: set[int] = set()
        cards: set[int] = set()
        tens: dict[int, int] = {}
        for i, c in enumerate(cores):
            if IBAN_HEAD.match(c) and (end := iban_run(i, at, cores, after)) > i:
                self.whole |= dict.fromkeys(range(first + i, first + end + 1), first + i)
            if i not in phones and PHONE_HEAD.match(c) and (end := phone_run(i, at, cores)) > i:
                phones |= set(range(i, end + 1))
            if i not in cards and len(c) == 4 and (end := card_run(i, at, cores)) > i:
                cards |= set(range(i, end + 1))
            if i not in tens and len(c) == 3 and ten_run(i, at, cores):
                tens |= dict.fromkeys(range(i, i + 3), i)
        for i, c in enumerate(cores):
            f = [*shape(c), "bias"]
            if first + i in self.whole:
                f.append("iban group")
            if i in phones:
                f.append("phone group")
            if i in cards:
                f.append("card group")
            if i in tens:
                # the word before the first group speaks for all three
                f.append("ten group " + str(_CONTEXT.get(before[tens[i]].strip(STRIP + "()").lower())))
            left, right = i > 0 and at[i - 1] == at[i] - 1, i + 1 < len(at) and at[i + 1] == at[i] + 1
            for side, word in (("before ", before[i]), ("after ", after[i])):
                kind = _CONTEXT.get(word.strip(STRIP + "()").lower())
                if kind:
                    f.append(side + kind)
            if left:
                f += ["left " + x for x in shape(cores[i - 1]) if x in ("country code", "area code", "seven with mark")]
                self.chain.append((first + i - 1, first + i))
            if right:
                f += ["right " + x for x in shape(cores[i + 1]) if x in ("country code", "area code", "seven with mark")]
            if group[i]:
                a = b = i
                while a and group[a - 1] and at[a - 1] == at[a] - 1 and i - a < 4:
                    a -= 1
                while b + 1 < len(at) and group[b + 1] and at[b + 1] == at[b] + 1 and b - i < 4:
                    b += 1
                f.append("four groups" if b - a + 1 >= 4 else "fewer groups")
            self.features.append(f)
            self.open.append((not left, not right))
            k = key_of(c)
            if k is not None:
                if k in last:
                    self.skip.append((last[k], first + i))
                last[k] = first + i


def training_documents(n: int = 700, seed: int = 5):
    """(tokens, labels) of made-up documents: random words with entities and with numbers that are none."""
    rng = np.random.default_rng(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))

    def word():
        return "".join(rng.choice(syllables, int(rng.integers(1, 4))))

    def entity():
        kind = int(rng.integers(0, 20))
        if kind < 4:
            name = word() + rng.choice(["", ".", "_", "+"]) + rng.choice([d(2), word()])
            return ([f"{name}@{word()}{rng.choice(['', d(1)])}.{rng.choice(['com', 'org', 'example.com', 'net', 'de'])}"], ["EMAIL"], "mail")
        if kind < 8:
            form = int(rng.integers(0, 6))
            t = ([f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"+{d(2)}{d(9)}"], [f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}"], [f"{d(3)}.{d(3)}.{d(4)}"])[form]
            return (t, ["PHONE"] * len(t), "phone")
        if kind < 11:
            x = (rng.choice(list("23456")) if rng.random() < 0.5 else d(1)) + d(15)
            t = ([x], [x], [x[:4], x[4:8], x[8:12], x[12:]], ["-".join((x[:4], x[4:8], x[8:12], x[12:]))])[int(rng.integers(0, 4))]
            return (t, ["CARD"] * len(t), "card")
        if kind < 14:
            return ([".".join(str(rng.integers(1, 256)) for _ in range(4))], ["IP"], "ip")
        if kind == 14:
            return ([f"{d(3)}-{d(2)}-{d(4)}"], ["SSN"], "ssn")
        if kind == 15:
            body = d(18)
            check = 98 - int(body + "131400") % 97
            return ([f"DE{check:02d}{body}"], ["IBAN"], "iban")
        none = int(rng.integers(0, 18))
        t = (d(1), d(2), str(rng.integers(1900, 2040)), d(5), d(6), f"{rng.integers(1, 9)}.{rng.integers(0, 30)}", f"{rng.integers(0, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}", f"20{d(2)}-0{rng.integers(1, 9)}-1{d(1)}", f"{rng.integers(10, 23)}:{rng.integers(10, 59)}", f"${d(2)},{d(3)}.{d(2)}", f"{d(2)}%", "".join(rng.choice(list("0123456789abcdef"), 40)), d(8), "@" + word(), f"97{rng.integers(8, 10)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", d(int(rng.integers(13, 20))), d(16), ".".join(d(1) for _ in range(4)))[none]
        return ([t], ["O"], "version" if none in (5, 6) else "sure version" if none == 17 else "sure amount" if none > 14 else "amount")

    for _ in range(n):
        tokens, labels, pool = [], [], [entity() for _ in range(int(rng.integers(1, 5)))]
        for _ in range(int(rng.integers(2, 9))):
            tokens += [word() for _ in range(int(rng.integers(0, 4)))]
            t, y, kind = pool[int(rng.integers(0, len(pool)))] if rng.random() < 0.5 else entity()
            labels += ["O"] * (len(tokens) - len(labels))
            # a long number that is no card says so by the word before it
            if rng.random() < 0.3 or kind.startswith("sure"):
                tokens.append(str(rng.choice(sorted(CONTEXT[kind.removeprefix("sure ")]))))
                labels.append("O")
            end = str(rng.choice(["", "", ".", ",", "!!", "###"]))
            tokens += [*t[:-1], t[-1] + end]
            labels += y
        yield tokens, labels
    # numbers of other countries: grouped IBANs and national phone numbers
    for _ in range(n // 5):
        tokens = [word() for _ in range(int(rng.integers(0, 3)))]
        labels = ["O"] * len(tokens)
        for _ in range(int(rng.integers(1, 4))):
            form = rng.random()
            if form < 0.25:
                hexed = "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(8, 41)))) + d(1)
                glue = str(rng.choice(sorted(CONTEXT["secret"]))) + "="
                t = [["AKIA" + d(1) + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 15))], [f"{glue}{hexed}"], [f"{glue}{word()}{d(2)}{word()}{d(1)}"], [f"{glue}{d(8)}"], [f"sk_live_{hexed * 2}"]][int(rng.integers(0, 5))]
                name, kind, y = "SECRET", "secret", ["SECRET"]
            elif form < 0.55:
                country, bank = [("DE", ""), ("GB", "NWBK"), ("FR", ""), ("ES", "")][int(rng.integers(0, 4))]
                body = bank + d(14 if bank else 20 if country != "DE" else 18)
                check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
                x = f"{country}{check:02d}{body}"
                t, name, kind = [x[k : k + 4] for k in range(0, len(x), 4)], "IBAN", "iban"
                y = [name if is_candidate(g) else "O" for g in t]
            else:
                area = f"0{rng.integers(1, 10)}{d(int(rng.integers(1, 3)))}"
                t = ([area, d(int(rng.integers(6, 9)))], [f"({area})", d(7)], [f"{area}/{d(7)}"], [f"{area}-{d(7)}"], [f"+{rng.integers(20, 99)}", area[1:], d(7)], [f"0{rng.integers(1, 10)}", d(2), d(2), d(2), d(2)], [f"+{rng.integers(20, 99)}", d(2), d(4), d(4)], [f"({area}){d(7)}"])[int(rng.integers(0, 8))]
                name, kind, y = "PHONE", "phone", ["PHONE"] * len(t)
            if rng.random() < 0.3 and kind != "secret":
                tokens.append(str(rng.choice(sorted(CONTEXT[kind]))))
                labels.append("O")
            mixed = [f"{word()}{d(int(rng.integers(1, 4)))}", f"{word()}{d(1)}{word()}", f"{word()[:2].upper()}{d(2)}", f"{word()[:1].upper()}{d(1)}", f"{d(2)}{word()}", f"{word().upper()}{d(2)}{word().upper()}{d(7)}"][int(rng.integers(0, 6))]
            tokens += [*t, word(), d(int(rng.integers(1, 7))), word(), mixed]
            labels += [*y, "O", "O", "O", "O"]
        yield tokens, labels


    # addresses of the sixth version, card numbers with check digits, groups of three, three and four, and what looks like them
    for _ in range(n // 4):
        tokens, labels = [word() for _ in range(int(rng.integers(0, 3)))], []
        labels = ["O"] * len(tokens)
        for _ in range(int(rng.integers(1, 4))):
            form = int(rng.integers(0, 6))
            h = lambda: f"{int(rng.integers(0, 65536)):x}"
            if form == 0:
                k = int(rng.integers(1, 6))
                t = [[":".join(h() for _ in range(8))], [":".join(h() for _ in range(k)) + "::" + ":".join(h() for _ in range(6 - k))], [f"fe80::{h()}"], ["::1"], [f"2001:db8::{h()}/64"], [f"::ffff:10.{d(1)}.{d(2)}.{d(1)}"]][int(rng.integers(0, 6))]
                kind, y = "ip", ["IP" if ip6(t[0]) else "O"]
            elif form == 1:
                sizes = [(4, 4, 4, 4), (4, 6, 5), (16,), (15,), (4, 4, 4, 4)][int(rng.integers(0, 5))]
                x = str(rng.choice(["34", "37"] if sum(sizes) == 15 else ["4", "51", "55", "60", "22"]))
                x += d(sum(sizes) - 1 - len(x))
                x += next(c for c in "0123456789" if luhn(x + c))
                t = [x[sum(sizes[:j]) : sum(sizes[: j + 1])] for j in range(len(sizes))]
                kind, y = "card", ["CARD"] * len(t)
            elif form == 2:
                t, kind, y = [d(3), d(3), d(4)], "phone", ["PHONE"] * 3
            elif form == 3:
                # counts and tables
                t, kind = [[d(3), d(3), d(4)], [d(2), d(3), d(3)], [d(1), d(3), d(3)], [d(2), d(2), d(2), d(2)], [d(3), d(3)]][int(rng.integers(0, 5))], "amount"
                y = ["O"] * len(t)
            elif form == 4:
                t, kind, y = [":".join(f"{int(rng.integers(0, 256)):02x}" for _ in range(6))], "amount", ["O"]
            else:
                t, kind = [d(int(rng.integers(14, 17)))], "amount"
                y = ["O"]
            if rng.random() < 0.5 or form in (3, 5):
                tokens.append(str(rng.choice(sorted(CONTEXT[kind]))))
                labels.append("O")
            tokens += [*t, word(), d(int(rng.integers(1, 5))), word()]
            labels += [*y, "O", "O", "O"]
        yield tokens, labels


def nodes_of(tokens: list[str], nodes: Nodes) -> list[int]:
    """Add a list of tokens to ``nodes``; the token of each of its nodes."""
    owner, at, words = [], [], []
    place = 0
    for i, t in enumerate(tokens):
        for k, (a, b) in enumerate(pieces(t)):
            place += 2 if k else 1
            owner.append(i)
            at.append(place)
            words.append(t[a:b])
    some = [i for i, w in enumerate(words) if is_candidate(w)]
    nodes.add([at[i] for i in some], [words[i] for i in some], [words[i - 1] if i else "" for i in some], [words[i + 1] if i + 1 < len(words) else "" for i in some])
    return [owner[i] for i in some]


@functools.cache
def model() -> dict:
    """Weights: unary by feature, chain[from, to], skip (symmetric); by gradient steps on the pseudo-likelihood."""
    nodes, truth = Nodes(), []
    for tokens, labels in training_documents():
        truth += [LABELS.index(labels[i]) for i in nodes_of(tokens, nodes)]
    y = np.array(truth)
    names = {f: i for i, f in enumerate(sorted({f for fs in nodes.features for f in fs}))}
    x = np.zeros((len(y), len(names)))
    for i, fs in enumerate(nodes.features):
        x[i, [names[f] for f in fs]] = 1
    one = np.eye(K)
    left, right, far = np.zeros((len(y), K)), np.zeros((len(y), K)), np.zeros((len(y), K))
    ends = np.array(nodes.open)
    left[ends[:, 0], 0] = right[ends[:, 1], 0] = 1
    for i, j in nodes.chain:
        left[j] += one[y[i]]
        right[i] += one[y[j]]
    for i, j in nodes.skip:
        far[j] += one[y[i]]
        far[i] += one[y[j]]
    u, t, s = np.zeros((len(names), K)), np.zeros((K, K)), np.zeros((K, K))
    moment = [np.zeros_like(u), np.zeros_like(t), np.zeros_like(s)]
    for _ in range(600):
        z = x @ u + left @ t + right @ t.T + far @ s
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - one[y]) / len(y)
        gs = far.T @ g
        for w, m, d, l2 in ((u, moment[0], x.T @ g, 0.0003), (t, moment[1], left.T @ g + (right.T @ g).T, 0.001), (s, moment[2], (gs + gs.T) / 2, 0.001)):
            m *= 0.9
            m += d + l2 * w
            w -= 1.0 * m
    return {"names": names, "unary": u, "chain": t, "skip": s}


def potentials(nodes: Nodes, weights: dict) -> np.ndarray:
    """The unary log-potentials [nodes, labels], those of clamped neighbours included."""
    n = len(nodes.features)
    names, table = weights["names"], weights["unary"]
    which = np.fromiter((names[f] for fs in nodes.features for f in fs if f in names), np.int64)
    owner = np.repeat(np.arange(n), [sum(f in names for f in fs) for fs in nodes.features])
    unary = received(owner, table[which], n) if len(which) else np.zeros((n, K))
    ends = np.array(nodes.open).reshape(-1, 2)
    return unary + ends[:, :1] * weights["chain"][0] + ends[:, 1:] * weights["chain"][:, 0]


def label(nodes: Nodes, weights: dict) -> np.ndarray:
    """The label with the greatest belief of each node."""
    return beliefs(nodes, weights).round(9).argmax(1)


def beliefs(nodes: Nodes, weights: dict) -> np.ndarray:
    """The log-beliefs [nodes, labels], by loopy belief propagation over all documents at once; exact where the edges form no loop."""
    unary = potentials(nodes, weights)
    edges = nodes.chain + nodes.skip
    if not edges:
        return unary
    e = np.array(edges)
    n, chain = len(e), len(nodes.chain)
    source, target = np.concatenate((e[:, 0], e[:, 1])), np.concatenate((e[:, 1], e[:, 0]))
    back = np.concatenate((np.arange(n) + n, np.arange(n)))
    # messages along the chain, along the skips, and back along either: the factor that each is multiplied with
    kinds = [(0, chain, weights["chain"]), (chain, n, weights["skip"]), (n, n + chain, weights["chain"].T), (n + chain, 2 * n, weights["skip"])]
    factors = [(a, b, np.exp(w)) for a, b, w in kinds if b > a]
    message = np.zeros((2 * n, K))
    for _ in range(ROUNDS):
        belief = unary + received(target, message, len(unary))
        out = belief[source] - message[back]
        out -= out.max(1, keepdims=True)
        np.exp(out, out)
        new = np.empty_like(message)
        for a, b, factor in factors:
            np.log(out[a:b] @ factor, new[a:b])
        new -= new.max(1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
    return unary + received(target, message, len(unary))


def received(target: np.ndarray, message: np.ndarray, n: int) -> np.ndarray:
    """The sum of the messages to each of n nodes."""
    return np.stack([np.bincount(target, message[:, k], n) for k in range(K)], 1)


def entities(texts: pa.Array, weights: dict) -> list[list[tuple[str, int, int]]]:
    """(label, start, end) of each entity of each text; places count bytes of UTF-8."""
    data, offsets = tb.byte_view(texts)
    starts, ends, doc = tb.word_spans(data, offsets, BLANKS)
    seen = np.concatenate(([0], np.cumsum(EVIDENCE[data])))
    found = np.flatnonzero(seen[ends] > seen[starts])
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    if not len(found):
        return out
    raw = data.tobytes()
    token = lambda i: raw[starts[i] : ends[i]].decode("utf-8", "replace")

    def edge(i: int, which: int) -> str:
        t = token(i)
        a, b = pieces(t)[which]
        return t[a:b]

    nodes, spans = Nodes(), []
    for chunk in np.split(found, np.flatnonzero(doc[found][1:] != doc[found][:-1]) + 1):
        k = doc[chunk[0]]
        at, cores, before, after = [], [], [], []
        shift = 0
        for i in chunk.tolist():
            t = token(i)
            places = pieces(t)
            words = [t[a:b] for a, b in places]
            low, done = int(starts[i] - offsets[k]), 0
            for j, ((a, b), w) in enumerate(zip(places, words)):
                low += len(t[done:a].encode())
                high = low + len(w.encode())
                if is_candidate(w):
                    at.append(i + shift + 2 * j)
                    cores.append(w)
                    before.append(words[j - 1] if j else edge(i - 1, -1) if i and doc[i - 1] == k else "")
                    after.append(words[j + 1] if j + 1 < len(words) else edge(i + 1, 0) if i + 1 < len(doc) and doc[i + 1] == k else "")
                    spans.append((k, at[-1], low, high))
                low, done = high, b
            shift += 2 * (len(places) - 1)
        nodes.add(at, cores, before, after)
    last = None
    for node, ((k, i, a, b), y) in enumerate(zip(spans, label(nodes, weights))):
        if y and LABELS[y] == "IBAN" and last is not None and last[2] == y and nodes.whole.get(node, -1) == nodes.whole.get(node - 1):
            out[k][-1] = ("IBAN", out[k][-1][1], b)
            last = (k, i, y)
        elif y and b > a:
            whole = LABELS[y] == "CARD" and (b - a >= 13 or out[k] and out[k][-1][2] - out[k][-1][1] >= 16)
            if last == (k, i - 1, y) and LABELS[y] in ("PHONE", "CARD") and not whole:
                out[k][-1] = (LABELS[y], out[k][-1][1], b)
            else:
                out[k].append((LABELS[y], a, b))
            last = (k, i, y)
        else:
            last = None
    return out


def _redacted(raw: bytes, found: list[tuple[str, int, int]]) -> str:
    at, out = 0, []
    for name, a, b in found:
        out += [raw[at:a], f"[{name}]".encode()]
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


KIND = "array<struct<label:string,start:int,end:int>>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_entities, entities) of each row: the text redacted; places count characters of the original."""
    docs = plain(docs, ["doc_id", "text"]).select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for batch in batches:
            _, offsets = tb.byte_view(batch.column("text"))
            for i, j in tb.chunks(offsets):
                part = batch.slice(i, j - i)
                texts = part.column("text").to_pylist()
                found = entities(part.column("text"), shared.value)
                rows = []
                for k, f in enumerate(found):
                    if f:
                        raw = texts[k].encode()
                        # characters before each byte: one that doesn't continue a character begins one
                        before = None if len(raw) == len(texts[k]) else np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                        char = (lambda p: p) if before is None else (lambda p, before=before: int(before[p]))
                        rows.append([{"label": name, "start": char(a), "end": char(b)} for name, a, b in f])
                        texts[k] = _redacted(raw, f)
                    else:
                        rows.append([])
                kind_ = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(r) for r in rows], pa.int32()), pa.array(rows, kind_)], names=["doc_id", "text", "n_entities", "entities"])

    return docs.mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, text string, n_entities int, entities {KIND}")


def query(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with their columns, entities replaced by ``[LABEL]``; n_chars follows where it is a column."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def clean(texts):
        found = entities(pa.array(texts, pa.string()), shared.value)
        return texts.where([not f for f in found], [_redacted(t.encode(), f) if f else t for t, f in zip(texts, found)])

    inner = plain(docs, ["text"], ["n_chars"])
    out = inner.withColumn("clean", clean("text"))
    changes = {"text": F.col("clean")}
    if "n_chars" in inner.columns:
        changes["n_chars"] = F.when(F.col("clean").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("clean").cast(inner.schema["n_chars"].dataType))
    return restored(out.withColumns(changes), inner, docs)
