"""Personal data: base patterns, and candidate spans selected by boosted trees (native).

Base spans come from four patterns with checks. Besides, generators with high recall
propose spans that may overlap: numbers inside longer runs of digits, telephone
numbers without a plus, spelt-out mail addresses, IPv6 addresses, account and national
numbers, secrets (plain, in dotted parts, in Base64, private key blocks). Boosted
trees score each proposal by its format and its context; one is selected if its score
reaches the threshold that was calibrated for its generator. Selected spans that overlap
become one, so that no part of a selected span is left over; its kind is that of the
best score, the first of equal ones. Base spans always stay, and what lies inside one
isn't added.

All work on documents is in SQL expressions. The trees are fitted on the driver from a
seeded set of made-up proposals (``examples``), the thresholds on sentences of another
origin (``calibration``), in which the generators themselves find their proposals; the
trees become nested CASE expressions.

The patterns are written with possessive runs, as in a run of one class of characters
every start but the first fails like the first, so that a long run is read once; the
base ones match what their plain forms do. No generator has an upper length.

Defined results: a null text is empty and stays null in ``redact``; repeated rows are
handled each for itself; an empty table gives an empty result; offsets are code points.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import pick
from skein.llm.gbdt import Trees, fit

KINDS = ("email", "ip", "card", "phone", "secret", "account", "national_id")
#: Base patterns by kind; \G lets a match start where the one before ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: name, kind, pattern, and a cheap test that a text must pass first.
GENERATORS = (
    ("digits", "card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", "digit"),
    ("fours", "card", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])", "digit"),
    ("local", "phone", r"(?<![0-9A-Za-z.])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "digit"),
    ("spelt", "email", r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]++(?:\x20?(?:\(at\)|\[at\])\x20?[A-Z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Z0-9-]++)++|\x20at\x20[A-Z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Z0-9-]++)++)", "spelt"),
    ("long_ip", "ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "colon"),
    ("secret", "secret", r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{20,}+", "long"),
    ("short_ip", "ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![0-9A-Za-z:])", "colons"),
    ("dotted", "secret", r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+)++", "dotted"),
    ("padded", "secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9_-]*+[+/][A-Za-z0-9+/_-]{15,}+={0,3}+|(?<![A-Za-z0-9+/_-])[A-Za-z0-9_-]{16,}+(?:[+/][A-Za-z0-9+/_-]*+={0,3}+|={1,3}+(?![A-Za-z0-9=]))", "padded"),
    ("key_block", "secret", r"-----BEGIN\x20(?=[A-Z0-9\x20]*PRIVATE\x20KEY)[A-Z0-9\x20]++-----\s*+(?:[A-Za-z0-9]++-[A-Za-z0-9]++:[^\n]*+\n){0,4}+[^-]*+-----END\x20[A-Z0-9\x20]++-----", "block"),
    ("iban", "account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "iban"),
    ("national", "national_id", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])", "digit"),
)
TESTS = {"digit": r"[0-9]", "spelt": r"(?i)[\x20\[(]at[\x20\])]", "colon": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "colons": r"::", "long": r"[A-Za-z0-9_-]{20}", "dotted": r"[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{8}", "padded": r"[A-Za-z0-9_-]{15}[+/=]|[+/][A-Za-z0-9+/_-]{15}", "block": r"PRIVATE\x20KEY-----", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"}
CONTEXT = 24  #: code points looked at before a span
#: Words that announce a kind, by what they announce. Fixed values.
CUES = {
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|telefon)",
    "mail": r"(?i)(?:mail|contact|write|reach|address)",
    "secret": r"(?i)(?:token|secret|passw|api.?key|apikey|auth|bearer|credential|private.?key|access.?key|client.?key|session|cookie|jwt)",
    "account": r"(?i)(?:iban|account|konto|bank|cuenta|compte)",
    "national": r"(?i)(?:ssn|social|national|insurance|tax|passport)",
    "other": r"(?i)(?<![A-Za-z])(?:order|invoice|isbn|version|ref|serial|tracking|id|page|commit|sha|checksum|volume|part|file|path|url)(?![a-z])",
}
FEATURES = ("generator", "length", "digits", "letters", "uppers", "marks", "wordlike", "slashes", "checked", "joined_left", "joined_right", "quoted", "domain", *(f"cue_{c}" for c in CUES))
#: Ends of a mail address that make it likelier. Fixed values.
DOMAINS = r"(?i)[.\x20)\]](?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk)$"
EXAMPLES = 4_000  #: made-up proposals of the first kinds; those of the others come on top
PRECISION = 0.97
SCAN = 256  #: entries of an array whose running values are made from the start of their block


# what the trees are fitted on


def luhn(digits: str) -> bool:
    return bool(digits) and sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def remainder97(account: str) -> int:
    """An account number's remainder, letters as two digits, the first four characters last; 1 if it is valid."""
    x = re.sub("[^A-Z0-9]", "", account)
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4]) or "0") % 97


def features(generator: int, span: str, before: str, after: str) -> list[float]:
    """As in ``_features``, of one proposal."""
    count = lambda p: len(re.findall(p, span))
    name = GENERATORS[generator][0]
    checked = remainder97(span) == 1 if name == "iban" else not re.match("000|666|9", span) and span[4:6] != "00" and span[7:] != "0000" if name == "national" else luhn(re.sub("[^0-9]", "", span)) if name in ("digits", "fours") else False
    return [generator, len(span), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("[^A-Za-z0-9]"), count("[a-z]{4,}+"), count("[/+=]"), checked, bool(re.search(r"[0-9][._-]?\Z", before[-2:])), bool(re.match(r"[._-]?[0-9]", after[:2])), bool(re.search(r"[=:\"'`]\x20?\Z", before[-2:])), bool(re.search(DOMAINS, span)), *(bool(re.search(p, before)) for p in CUES.values())]


class _Made:
    """Seeded made-up values."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def of(self, among: str, k: int) -> str:
        return "".join(self.rng.choice(among) for _ in range(k))

    def digits(self, k: int) -> str:
        return self.of(string.digits, k)

    def word(self) -> str:
        return self.of(string.ascii_lowercase, self.rng.randint(2, 9))

    def card(self, k: int = 16, good: bool = True) -> str:
        body = self.digits(k - 1)
        return next(body + c for c in string.digits if luhn(body + c) == good)

    def fours(self, good: bool = True) -> str:
        s = self.card(16, good)
        return self.rng.choice(" -").join(s[i : i + 4] for i in range(0, 16, 4))

    def local(self) -> str:
        return self.rng.choice(["{}-{}-{}", "({}) {}-{}", "{}.{}.{}", "{} {} {}"]).format(self.digits(3), self.digits(3), self.digits(4))

    def spelt(self) -> str:
        return f"{self.rng.choice([self.word(), self.word() + '.' + self.word(), self.word() + self.digits(2)])}{self.rng.choice([' at ', ' (at) ', '(at)', ' [at] '])}{self.word()}{self.rng.choice([' dot ', '(dot)', ' [dot] '])}{self.rng.choice(['com', 'org', 'net', 'de'])}"

    def hexes(self, k: int, up: bool = False) -> str:
        return self.of("0123456789ABCDEF" if up else "0123456789abcdef", k)

    def mixed(self, k: int, more: str = "") -> str:
        return self.of(string.ascii_letters + string.digits + more, k)

    def base64(self, k: int) -> str:
        return self.mixed(k - 2) + self.rng.choice("+/") + self.mixed(1, "+/") + "=" * self.rng.randint(0, 2)

    def jwt(self) -> str:
        return ".".join(["eyJ" + self.mixed(self.rng.randint(15, 60), "_-"), "eyJ" + self.mixed(self.rng.randint(20, 300), "_-"), self.mixed(self.rng.choice([43, 86]), "_-")])

    def short_ip(self) -> str:
        head = ":".join(self.hexes(self.rng.randint(1, 4)) for _ in range(self.rng.randint(2, 4)))
        return head + "::" + ":".join(self.hexes(self.rng.randint(1, 4)) for _ in range(self.rng.randint(0, 3)))

    def iban(self, good: bool = True) -> str:
        country, body = self.rng.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), self.digits(self.rng.choice([14, 18, 20]))
        if country in ("GB", "NL"):
            body = self.of(string.ascii_uppercase, 4) + body[4:]
        check = (98 - remainder97(f"{country}00{body}") + (0 if good else self.rng.randint(1, 96))) % 97
        whole = f"{country}{check or 97:02d}{body}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if self.rng.random() < 0.6 else whole

    def national(self, good: bool = True) -> str:
        return f"{self.rng.randint(100, 665) if good else self.rng.choice(['000', '666', '987'])}-{self.rng.randint(10, 99)}-{self.rng.randint(1000, 9999)}"

    def key_block(self) -> str:
        kind = self.rng.choice(["RSA ", "EC ", "OPENSSH ", "ENCRYPTED ", ""])
        return f"-----BEGIN {kind}PRIVATE KEY-----\n" + self.rng.choice(["", "Proc-Type: 4,ENCRYPTED\n\n"]) + "\n".join(self.mixed(self.rng.randint(3, 64), "+/") for _ in range(self.rng.randint(1, 20))) + f"\n-----END {kind}PRIVATE KEY-----"

    def path(self) -> str:
        return self.rng.choice(["/", ""]) + "/".join(self.word() for _ in range(self.rng.randint(4, 9)))

    def host(self) -> str:
        return ".".join(self.of(string.ascii_lowercase, self.rng.randint(8, 12)) for _ in range(self.rng.randint(2, 4)))


def examples(n: int = EXAMPLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Labelled proposals: made-up personal data of many shapes, and look-alikes."""
    made = _Made(seed)
    rng, word = made.rng, made.word
    text = lambda: " ".join(word() for _ in range(4))
    cue = {"card": ["card ", "visa: ", "credit card "], "phone": ["phone ", "tel. ", "call "], "mail": ["mail ", "write to ", "contact: "], "secret": ["token = \"", "api_key: ", "password=", "secret = '", "TOKEN = \"", "Authorization: Bearer ", "access_key="], "account": ["IBAN ", "account: ", "bank account "], "national": ["SSN ", "social security number "], "other": ["order ", "invoice no. ", "ISBN ", "serial ", "commit ", "sha ", "file ", "path "]}
    says = lambda kind, often: rng.choice(cue[kind]) if rng.random() < often else ""
    far = lambda: rng.choice([" ", ", ", ". ", "\n"])
    number = {g[0]: i for i, g in enumerate(GENERATORS)}
    x, y = [], []

    def add(generator, span, before, after, label):
        x.append(features(number[generator], span, before[-CONTEXT:], after[:2]))
        y.append(label)

    for _ in range(n // 16):
        add("digits", made.card(rng.choice([13, 15, 16, 16, 16, 19])), text() + far() + says("card", 0.3), far() + text(), 1)
        add("digits", made.card(), text() + far() + made.card(16, False) + " ", far() + text(), 1)
        add("digits", made.card(), text() + far(), " " + made.digits(16) + far(), 1)
        add("digits", made.card(rng.randint(13, 19), False), text() + far() + says("other", 0.5), far() + text(), 0)
        add("digits", made.card(rng.randint(13, 19)), text() + far() + rng.choice(cue["other"]), far() + text(), 0)
        add("fours", made.fours(), text() + far() + says("card", 0.4), far() + text(), 1)
        add("fours", made.fours(False), text() + far() + says("other", 0.5), far() + text(), 0)
        add("local", made.local(), text() + far() + says("phone", 0.4), far() + text(), 1)
        add("local", made.local(), text() + far() + made.local() + " ", " " + made.local(), 1)
        add("local", made.local(), text() + far() + made.digits(3) + rng.choice("-."), rng.choice("-.") + made.digits(3), 0)
        add("local", made.local(), text() + far() + rng.choice(cue["other"]), far() + text(), 0)
        add("spelt", made.spelt(), text() + far() + says("mail", 0.5), far() + text(), 1)
        add("spelt", f"{word()}{rng.choice(['', '.'])}{rng.choice([' at ', ' [at] '])}{word()} dot {word()}", text() + far(), far() + text(), 0)
        add("long_ip", ":".join(made.hexes(4) for _ in range(8)), text() + far(), far() + text(), 1)
        add("short_ip", made.short_ip(), text() + far(), far() + text(), 1)
        add("short_ip", f"{made.hexes(rng.randint(1, 2))}::{made.hexes(rng.randint(1, 2))}", text() + far(), far() + text(), 0)
        add("secret", made.hexes(rng.choice([24, 32, 40, 64]), rng.random() < 0.3), text() + far() + rng.choice(cue["secret"]), rng.choice(['"', "'", " ", ","]), 1)
        add("secret", made.mixed(rng.choice([20, 24, 32, 40])), text() + far() + rng.choice(cue["secret"]), rng.choice(['"', "'", " "]), 1)
        add("secret", rng.choice([made.hexes(40), word() + "-" + word() + "-" + word() + "-" + word() + "-" + word(), "".join(word() for _ in range(5)), made.digits(rng.randint(20, 40))]), text() + far() + says("other", 0.5), far() + text(), 0)
        long = rng.choice([129, 160, 200, 256, 342, 512, 1024, rng.randint(129, 12_000)])
        add("secret", rng.choice([made.hexes, made.mixed, lambda k: made.mixed(k, "_-")])(long), text() + far() + rng.choice(cue["secret"]), rng.choice(['"', "'", " ", ","]), 1)
        add("secret", rng.choice([made.digits(long), rng.choice("-_xX") * long, made.of("ACGT", long), rng.choice(["-", "_", ""]).join(word() for _ in range(long // 4))]), text() + far() + says("other", 0.5), far() + text(), 0)
        add("dotted", made.jwt(), text() + far() + says("secret", 0.7), far() + text(), 1)
        add("dotted", rng.choice([made.host(), made.host() + "." + made.digits(8), "_".join(word() for _ in range(3)) + "." + made.word() * 3]), text() + far() + says("other", 0.3), far() + text(), 0)
        add("padded", made.base64(rng.choice([24, 32, 40, 44, 64, 88, long])), text() + far() + rng.choice(cue["secret"]), rng.choice(['"', "'", " ", ","]), 1)
        add("padded", rng.choice([made.path(), made.path() + "/" + made.digits(6), made.word() * 4 + "=" + made.word(), "a/b/c/d/e/f/g/h/i/j", "+/" * 15]), text() + far() + says("other", 0.4), far() + text(), 0)
        add("key_block", made.key_block(), text() + far(), far() + text(), 1)
        add("iban", made.iban(), text() + far() + says("account", 0.4), far() + text(), 1)
        add("iban", made.iban(False), text() + far() + says("other", 0.5), far() + text(), 0)
        add("national", made.national(), text() + far() + says("national", 0.6), far() + text(), 1)
        add("national", made.national(rng.random() < 0.5), text() + far() + rng.choice(cue["other"]), far() + text(), 0)
    return np.array(x, float), np.array(y, float)


#: Sentences for the thresholds: ``{}`` is where a made-up value goes, by kind of value; "not" ones are look-alikes.
SENTENCES = {
    "card": ["Please charge {} for the room.", "My Visa number is {}, valid until May.", "He read out {} over the line", "Paid with {} yesterday.", "cards: {} {}", "{}"],
    "not card": ["Your order {} has been shipped.", "The tracking number {} was scanned in Cologne.", "invoice {} is overdue", "Measured {} photons in total."],
    "phone": ["Call {} after six.", "You can reach me under {}.", "Numbers: {} {} {}", "fax {}, office {}", "Front desk {}"],
    "not phone": ["Part 12-{}-55 is out of stock", "the ISBN {} belongs to it", "see version {}"],
    "email": ["Write to {} for tickets.", "Contact {} or come by", "I am {} if you need me."],
    "not email": ["We met at noon dot and left", "Look at this dot matrix"],
    "ip": ["The host {} answers no longer.", "ping {}", "route via {} dev eth0", "Connection from {} refused"],
    "not ip": ["the ratio was 1::2 in the end", "use a::b there"],
    "secret": ["export API_KEY={}", "token: {}", "the password is \"{}\"", "Authorization: Bearer {}", "secret = '{}';", "curl -H 'Cookie: session={}'"],
    "not secret": ["commit {} fixes it", "see /usr/share/doc/python/examples/{}", "sequence {} in the genome", "the file at {}", "https://www.example.org/{}"],
    "block": ["Here is the key:\n{}\nkeep it", "{}"],
    "account": ["Transfer it to {} by Friday.", "IBAN {}", "his account is {}, hers is {}"],
    "not account": ["serial {} on the back", "model {} was recalled"],
    "national": ["Her SSN is {}.", "social security number: {}", "born 1980, {}"],
    "not national": ["part {} is sold out", "order {} came late"],
}


def _value(made: _Made, kind: str) -> str:
    rng = made.rng
    word = lambda: "-".join(made.word() for _ in range(rng.randint(4, 9)))
    makers = {
        "card": [made.card, made.fours, lambda: made.card(15)], "not card": [lambda: made.card(rng.randint(13, 19), False), lambda: made.fours(False)],
        "phone": [made.local], "not phone": [made.local], "email": [made.spelt], "not email": [str], "not ip": [str],
        "ip": [made.short_ip, lambda: ":".join(made.hexes(4) for _ in range(8)), lambda: "::" + made.hexes(4) + ":" + made.hexes(4)],
        "secret": [lambda: made.hexes(rng.choice([32, 40, 64, 128, 2000])), lambda: made.mixed(rng.choice([24, 36, 48, 300, 9000])), lambda: made.base64(rng.choice([40, 60, 500])), made.jwt],
        "not secret": [lambda: made.hexes(40), word, made.path, made.host, lambda: made.of("ACGT", rng.randint(30, 400))],
        "block": [made.key_block], "account": [made.iban], "not account": [lambda: made.iban(False)], "national": [made.national], "not national": [lambda: made.national(rng.random() < 0.5)],
    }
    return rng.choice(makers[kind])()


def calibration(n: int = 60, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """Labelled proposals that the generators make in ``n`` fillings of each sentence: good if of the planted value's kind, within it and with most of it."""
    made = _Made(seed)
    patterns = [re.compile(p) for _, _, p, _ in GENERATORS]
    x, y = [], []
    for kind, sentences in SENTENCES.items():
        for sentence in sentences:
            for _ in range(n):
                text, planted = "", []
                for i, piece in enumerate(sentence.split("{}")):
                    if i:
                        planted.append((len(text), len(text) + len(value := _value(made, kind))))
                        text += value
                    text += piece
                for g, pattern in enumerate(patterns):
                    for m in pattern.finditer(text):
                        good = GENERATORS[g][1] == {"block": "secret", "national": "national_id"}.get(kind, kind) and any(s <= m.start() and m.end() <= e and 2 * (m.end() - m.start()) >= e - s for s, e in planted)
                        if good or kind.startswith("not"):
                            x.append(features(g, m[0], text[max(0, m.start() - CONTEXT) : m.start()], text[m.end() : m.end() + 2]))
                            y.append(good)
    return np.array(x, float), np.array(y, float)


@lru_cache(maxsize=1)
def model() -> tuple[Trees, dict[int, float]]:
    """Trees fitted on the examples, and a threshold for each generator from the calibration sentences.

    It lies below the last good proposal up to which ``PRECISION`` holds, half way to the
    next proposal. A generator whose proposals there are all alike keeps the even one.
    """
    x, y = examples()
    trees = fit(x, y, trees=40, depth=4, monotone={FEATURES.index("checked"): 1, FEATURES.index("cue_other"): -1})
    x, y = calibration()
    p, thresholds = trees.probability(x), {}
    for g in range(len(GENERATORS)):
        at = np.flatnonzero(x[:, 0] == g)
        order = at[np.lexsort((y[at], -p[at]))]
        good = np.flatnonzero((y[order] == 1) & (np.cumsum(y[order]) / np.arange(1, len(order) + 1) >= PRECISION))
        if not len(at) or y[at].min() == y[at].max():
            thresholds[g] = 0.5
        else:
            thresholds[g] = float(p[order][good[-1] : good[-1] + 2].mean()) if len(good) else 1.1
    return trees, thresholds


def _tree_sql(trees: Trees, node: int, at: str) -> str:
    f = int(trees.feature[node])
    if f < 0:
        return f"{trees.value[node]!r}D".replace("np.float64(", "").replace(")", "")
    return f"CASE WHEN {at}.{FEATURES[f]} < {float(trees.threshold[node])!r}D THEN {_tree_sql(trees, int(trees.left[node]), at)} ELSE {_tree_sql(trees, int(trees.right[node]), at)} END"


# what runs on documents


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once, as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _raw(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _scan(values: str, op: str) -> str:
    """Running values of an array of int from 0, each with its own. ``op`` joins a and b.

    In levels of blocks, so that the work grows nearly in proportion.
    """
    fold = lambda part: f"aggregate({part}, 0, (a, b) -> {op})"
    blocks = f"transform(sequence(0, int((size(v) - 1) div {SCAN})), c -> {fold(f'slice(v, c * {SCAN} + 1, {SCAN})')})"
    placed = f"transform(v, (x, i) -> {_let(f'get(before, int(i div {SCAN}))', 'a', _let(fold(f'slice(v, int(i div {SCAN}) * {SCAN} + 1, int(i % {SCAN}) + 1)'), 'b', op))})"
    levels = _let(blocks, "level", _let(f"transform(level, (x, c) -> {fold('slice(level, 1, c)')})", "before", placed))
    return _let(values, "v", f"CASE WHEN size(v) > 0 THEN {levels} ELSE cast(array() AS array<int>) END")


SUM, GREATER = "a + b", "greatest(a, b)"


def _positions(text: str, pattern: str) -> str:
    """All matches in order, as (s, e, hit) with code-point offsets, e exclusive.

    The gaps between the matches give the offsets: running sums of their lengths and the matches'.
    """
    steps = "transform(m.h, (x, i) -> length(m.g[i]) + length(x))"
    spans = _let(_scan(steps, SUM), "ends", "transform(m.h, (x, i) -> named_struct('s', ends[i] - length(x), 'e', ends[i], 'hit', x))")
    return _let(f"named_struct('g', split({text}, {_raw(pattern)}, -1), 'h', regexp_extract_all({text}, {_raw(pattern)}, 0))", "m", spans)


def _luhn(x: str) -> str:
    """Whether the digits of ``x`` pass."""
    doubled = "transform(split(reverse(d), ''), (c, i) -> element_at(transform(array(int(c) * (1 + i % 2)), w -> w - CASE WHEN w > 9 THEN 9 ELSE 0 END), 1))"
    return _let(f"regexp_replace({x}, '[^0-9]', '')", "d", f"CASE WHEN length(d) > 0 THEN aggregate({doubled}, 0, (a, b) -> a + int(b)) % 10 = 0 ELSE false END")


def _remainder97(account: str) -> str:
    """As ``remainder97``."""
    code = "CASE WHEN c BETWEEN '0' AND '9' THEN int(c) ELSE ascii(c) - 55 END"
    step = _let(code, "w", "(a * CASE WHEN w > 9 THEN 100 ELSE 10 END + w) % 97")
    return _let(f"regexp_replace({account}, '[^A-Z0-9]', '')", "d", f"aggregate(filter(split(concat(substring(d, 5), left(d, 4)), ''), c -> c <> ''), 0, (a, c) -> {step})")


#: What a match ``x.hit`` of a base pattern must satisfy.
_BYTE = r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
CHECKS = {
    "email": "true",
    "ip": f"forall(split(x.hit, r'\\.'), n -> n RLIKE {_raw(_BYTE)})",
    "card": f"CASE WHEN length(regexp_replace(x.hit, '[^0-9]', '')) BETWEEN 13 AND 19 THEN {_luhn('x.hit')} ELSE false END",
    "phone": "length(regexp_replace(x.hit, '[^0-9]', '')) BETWEEN 9 AND 15",
}


def _base(text: str, kind: str) -> str:
    """Array of (k, s, e) of one kind."""
    gate = {"email": f"instr({text}, '@') > 0", "phone": f"instr({text}, '+') > 0"}.get(kind, f"{text} RLIKE {_raw(TESTS['digit'])}")
    found = f"transform(filter({_positions(text, BASE[kind])}, x -> {CHECKS[kind]}), x -> named_struct('k', {KINDS.index(kind)}, 's', x.s, 'e', x.e))"
    return f"CASE WHEN {gate} THEN {found} ELSE cast(array() AS array<struct<k:int,s:int,e:int>>) END"


def _features(g: int, text: str) -> str:
    """Struct of the features of a proposal ``x``, as the trees were fitted on them."""
    checked = {"iban": f"{_remainder97('p.x')} = 1", "national": "NOT p.x RLIKE r'^(?:000|666|9)|-00-|-0000$'", "digits": _luhn("p.x"), "fours": _luhn("p.x")}.get(GENERATORS[g][0], "false")
    count = lambda drop: f"length(regexp_replace(p.x, '{drop}', ''))"
    like = lambda column, pattern: f"{column} RLIKE {_raw(pattern)}"
    values = [str(g), "length(p.x)", count("[^0-9]"), count("[^A-Za-z]"), count("[^A-Z]"), count("[A-Za-z0-9]"), "regexp_count(p.x, '[a-z]{4,}+')", count("[^/+=]"), checked, like("right(p.b, 2)", r"[0-9][._-]?\z"), like("p.a", r"\A[._-]?[0-9]"), like("right(p.b, 2)", r"[=:\"'`]\x20?\z"), like("p.x", DOMAINS), *(like("p.b", c) for c in CUES.values())]
    parts = f"named_struct('b', substring({text}, greatest(x.s - {CONTEXT}, 0) + 1, x.s - greatest(x.s - {CONTEXT}, 0)), 'a', substring({text}, x.e + 1, 2), 'x', x.hit)"
    return _let(parts, "p", "named_struct(" + ", ".join(f"'{n}', double({v})" for n, v in zip(FEATURES, values, strict=True)) + ")")


def _proposals(text: str) -> str:
    """Array of (k, s, e, f, t): the proposals of all generators with their features and thresholds."""
    _, thresholds = model()
    kind = "array<struct<k:int,s:int,e:int,f:struct<" + ",".join(f"{n}:double" for n in FEATURES) + ">,t:double>>"
    found = []
    for g, (_, name, pattern, test) in enumerate(GENERATORS):
        made = f"transform({_positions(text, pattern)}, x -> named_struct('k', {KINDS.index(name)}, 's', x.s, 'e', x.e, 'f', {_features(g, text)}, 't', {thresholds[g]!r}D))"
        found.append(f"CASE WHEN {text} RLIKE {_raw(TESTS[test])} THEN {made} ELSE cast(array() AS {kind}) END")
    return f"concat({', '.join(found)})"


def _joined(spans: str) -> str:
    """Spans (s, n = -e, e, p, k), sorted, with those that overlap made one, as (k, s, e): of the kind of the least p, the first of equal ones."""
    begins = "filter(transform(spans, (x, i) -> CASE WHEN i = 0 OR x.s >= get(reach, i - 1) THEN i END), i -> i IS NOT NULL)"
    part = "slice(spans, i + 1, coalesce(get(begin, j + 1), size(spans)) - i)"
    best = f"array_min(transform({part}, x -> named_struct('p', x.p, 's', x.s, 'k', x.k))).k"
    one = f"named_struct('k', {best}, 's', spans[i].s, 'e', reach[coalesce(get(begin, j + 1), size(spans)) - 1])"
    return _let(spans, "spans", _let(_scan("transform(spans, x -> x.e)", GREATER), "reach", _let(begins, "begin", f"transform(begin, (i, j) -> {one})")))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` (null as empty), ``_base``, ``_added`` and ``_all``: arrays of (k, s, e) in order of kind, start."""
    trees, _ = model()
    score = " + ".join([repr(float(trees.bias)) + "D", *(_tree_sql(trees, int(r), "c.f") for r in trees.roots)])
    rows = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumns({"_base": F.expr(f"concat({', '.join(_base('_text', k) for k in KINDS[:4])})"), "_proposed": F.expr(_proposals("_text"))})
    # what is under its threshold goes
    good = f"transform(filter(transform(_proposed, c -> named_struct('s', c.s, 'e', c.e, 'p', -1D / (1D + exp(-({score}))), 'k', c.k, 't', c.t)), c -> -c.p >= c.t), c -> named_struct('s', c.s, 'n', -c.e, 'e', c.e, 'p', c.p, 'k', c.k))"
    rows = rows.withColumn("_good", F.expr(f"CASE WHEN size(_proposed) > 0 THEN {good} ELSE cast(array() AS array<struct<s:int,n:int,e:int,p:double,k:int>>) END"))
    # base spans stand among the rest, before equal ones, to find what lies inside them
    both = "array_sort(concat(transform(_base, b -> named_struct('s', b.s, 'n', -b.e, 'e', b.e, 'p', -2D, 'k', b.k)), _good))"
    free = _let(both, "both", _let(_scan("transform(both, x -> CASE WHEN x.p < -1 THEN x.e ELSE 0 END)", GREATER), "taken", "filter(both, (x, i) -> x.p >= -1 AND x.e > taken[i])"))
    rows = rows.withColumn("_added", F.expr(f"CASE WHEN size(_good) > 0 THEN {_joined(free)} ELSE cast(array() AS array<struct<k:int,s:int,e:int>>) END"))
    return rows.withColumn("_all", F.array_sort(F.concat("_base", "_added"))).drop("_proposed", "_good")


def _named(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.k], cast(x.s as string), cast(x.e as string))), ',')"


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: the counts and the digest of the base spans, and all spans as text."""
    rows = with_spans(pick(docs, "doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(_base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(F.encode(F.expr(_named("_base")), "UTF-8"), 256).alias("base_sha256"), F.expr(_named("_all")).alias("spans"), F.size("_added").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; the same columns."""
    # the caller's columns travel as one, so that none of them can clash with those made here
    rows = with_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text"))
    # spans that overlap are one, of the kind of the one that starts first, or is longer or the first kind
    by_start = "array_sort(transform(_all, x -> named_struct('s', x.s, 'n', -x.e, 'k', x.k, 'e', x.e)))"
    merged = _joined(f"transform({by_start}, (x, i) -> named_struct('s', x.s, 'n', x.n, 'e', x.e, 'p', double(i), 'k', x.k))")
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    piece = f"concat(substring(_text, coalesce(get(m, i - 1).e, 0) + 1, x.s - coalesce(get(m, i - 1).e, 0)), {names}[x.k])"
    rebuilt = _let(merged, "m", f"concat(array_join(transform(m, (x, i) -> {piece}), ''), substring(_text, element_at(m, -1).e + 1))")
    text = F.expr(f"CASE WHEN size(_all) > 0 THEN {rebuilt} ELSE text END")
    return rows.select(*(text.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
