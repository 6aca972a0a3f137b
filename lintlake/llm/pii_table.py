"""The small labelled table that the personal-data model learns from.

Rows are sentences in four languages whose personal data stands in brackets, as [text|kind]. Each
template is filled REPEATS times; the values come from rules and a seeded generator, so the table is
the same everywhere. Names, streets and hosts are made of syllables: what is to be learned are
shapes and the words around them.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "ip", "card", "phone", "person", "address", "id")
REPEATS = 8

TEMPLATES = """
My name is [{name}|person] and I live at [{street}|address].
my name is [{name}|person], please call me on [{local}|phone] after {small} pm.
Please contact [{name}|person] at [{at}|email] for details.
Write to [{at}|email] or call [{local}|phone].
You can reach [{title} {name}|person] under [{phone}|phone].
Phone: [{local}|phone]
Tel. [{local}|phone], Fax [{local}|phone]
tel: [{phone}|phone]
mobile [{local}|phone] home [{local}|phone]
{word} {word} [{phone}|phone] {word} {word}.
{Word} {word}, {word} [{phone}|phone] [{card}|card] {word} {word}.
{word} {word} [{phone}|phone] [{ip}|ip] {word}.
{word} {word} [{card}|card] [{card}|card] {word} {word}
{word} {word} {word} [{card}|card] {word} {word}, {word}.
card number [{card}|card], expires {month}/{two}
Visa [{card}|card] {word}
{word} [{email}|email] {word} {word}.
{word} {word} [{email}|email], [{email}|email] {word}.
E-mail: [{at}|email]
e-mail [{at}|email] {word} {word}
{word} {word} [{ip}|ip] {word} {word}.
{Word} [{ip}|ip] [{card}|card] {word}
login from [{ip6}|ip] {word} {word}
IP address [{ip}|ip], {word}
{word} host [{ip6}|ip] {word}
Name: [{name}|person]
Full name: [{name}|person], born {day}.{month}.{year}
Patient [{name}|person] was admitted on {day} {Word} {year}.
Dear [{title} {name}|person], {word} {word} {word}.
Signed, [{name}|person]
Regards, [{name}|person]
Address: [{street}|address]
She lives at [{street}|address] with {word} {word}.
Ship to [{name}|person], [{street}|address]
SSN [{ssn}|id], {word}
social security number: [{ssn}|id]
Passport no. [{passport}|id] of [{name}|person]
IBAN [{iban}|id] {word}
pay to [{iban}|id] {word} {word}
{word} {word} IBAN: [{iban}|id].
Ich heiße [{name}|person] und wohne in der [{strasse}|address].
Mein Name ist [{name}|person], Telefon [{local}|phone].
Anschrift: [{strasse}|address]
Herr [{name}|person] wohnt [{strasse}|address].
Konto [{iban}|id] von [{name}|person]
Rufen Sie [{local}|phone] an.
Je m'appelle [{name}|person] et j'habite [{rue}|address].
Appelez [{name}|person] au [{local}|phone].
Adresse : [{rue}|address]
Me llamo [{name}|person] y vivo en [{calle}|address].
Llame al [{local}|phone], {word} {word}.
Dirección: [{calle}|address]
Contact [{name}|person], tel. [{phone}|phone], e-mail [{email}|email].
{Word} {word} {word} {word}, {word} {word} {word}.
{Word} {Word} {word}. {Word} {word} {word} {word}. {Word}, {word} {Word} {word}.
{word} {word} {word}, {word} {word} {word}, {word}. {Word}. {Word} {word}.
{Word}. {Word} {word}, {Word} {word}. {Word} {Word}.
THE {WORD} {WORD} OF {WORD}
{Word} | {word} | {Word} | {word} | {two} | {word}
{Word} | {small} | {decimal} | {year}-{month}-{day} | {Word} | {word}
It costs {decimal} dollars, or {thousands} in all.
On {year}-{month}-{day} at {month}:{two} {word} {word}.
Version {version} of {word} was released in {year}.
see section {section} and table {small}, pages {two}-{three}
{Word} has {two} apples and gives {small} to {Word}.
A train leaves {Word} at {small}:{two} and drives {three} kilometers to {Word}.
{Word} {Word} is {two} years old.
Copyright (c) {year}-{year} {Word} {Word}. All rights reserved.
Licensed under the Apache License, Version {section}.
This work is licensed under CC BY-NC {section}.
{word} = "{hex}" {word}
token: {hex}
password = {key}
id {digits} {word} {word}
order {digits}, {word} {word}
{word} {digits} {word} {digits}.
{word}({small}, {two}); {word}[{small}] += {two};
const {word} = require("{word}") // {word} {Word}
https://{word}.example/{word}/{two}?{word}={small}
{three}, {three}, {three}, {two}, {small}
{year} {year} {year} {word} {two} % {small} +{two} -{two}
The {Word} University of {Word} in {Word}, {word} {year}
call the {word} {word} at {word} dot {word}
name of the {word} {word}, address of the {word}, number {small}
{word}!! {word}!! {Word}!! {word}## {two}%%
Chapter {small}: {Word} and {Word}
{section} {section}. {section}.{small} {word}
RFC {year}, ISO {digits}, {word}
{word} {word} @ {word} {word} @{word}
{same} {same} {same} {same}
{Same} {Same} {Same}. {same} {same} {Same}
at at at at dot dot dot for for for for on on on of of of
{WORD} {WORD} {WORD}, {WORD} EL DE {WORD} {WORD}. {WORD} AT {WORD}
{Word}. {Word}. {Word}. A. {Word}. To. {Word}.
{word} to. {Word}. {Word} {Word}, {Word}. Of. {Word} {word}.
{WORD}!! {WORD}!! {Word}!! THE!! {WORD}!!
"""

_PART = re.compile(r"\[([^]|]*)\|(\w+)\]")
_SYLLABLES = (
    "an be ca do el fi go ha in jo ka le ma ne or pa qui ra sa ta ul ve wi xa ye zo "
    "ber chen dorf ell ing ment ner rot schel ton und vier"
).split()


def _luhn(head: str) -> str:
    total = sum(
        d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(head)))
    )
    return head + str(-total % 10)


class _Values:
    """A new value for every slot of the templates."""

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def digits_of(self, n: int) -> str:
        return "".join(self.rng.choices("0123456789", k=n))

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.choice([1, 1, 2, 2, 3, 4])))

    def same(self) -> str:
        return " ".join([self.word()] * self.rng.randint(2, 6))

    def Same(self) -> str:
        return " ".join([self.Word()] * self.rng.randint(2, 6))

    def Word(self) -> str:
        return self.word().capitalize()

    def WORD(self) -> str:
        return self.word().upper()

    def name(self) -> str:
        middle = self.rng.choice(["", "", "", f"{self.WORD()[0]}. "])
        return f"{self.Word()} {middle}{self.Word()}" + self.rng.choice(["", "", f"-{self.Word()}"])

    def title(self) -> str:
        return self.rng.choice(["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Mme", "Sr.", "Sra."])

    def small(self) -> str:
        return str(self.rng.randint(1, 9))

    def two(self) -> str:
        return str(self.rng.randint(10, 99))

    def three(self) -> str:
        return str(self.rng.randint(100, 999))

    def year(self) -> str:
        return str(self.rng.randint(1900, 2030))

    def month(self) -> str:
        return f"{self.rng.randint(1, 12):02d}"

    def day(self) -> str:
        return f"{self.rng.randint(1, 28):02d}"

    def decimal(self) -> str:
        return f"{self.rng.randint(0, 999)}.{self.rng.randint(0, 99):02d}"

    def thousands(self) -> str:
        return f"{self.rng.randint(1, 999)},{self.digits_of(3)}"

    def section(self) -> str:
        return f"{self.rng.randint(1, 9)}.{self.rng.randint(0, 9)}"

    def version(self) -> str:
        return ".".join(str(self.rng.randint(0, 20)) for _ in range(self.rng.choice([2, 3])))

    def digits(self) -> str:
        return self.digits_of(self.rng.randint(4, 14))

    def hex(self) -> str:
        return "".join(self.rng.choices("0123456789abcdef", k=self.rng.choice([32, 40])))

    def key(self) -> str:
        return "".join(self.rng.choices("ABCdefGHIjkl0123456789", k=self.rng.randint(10, 24)))

    def phone(self) -> str:
        a, b, c = self.digits_of(3), self.digits_of(3), self.digits_of(4)
        return self.rng.choice([
            f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+49 {a} {b}{c}",
            f"+33 {a[0]} {b[:2]} {c[:2]} {c[2:]} {a[1:]}", f"+{a[:2]}{b}{c}", f"+44 (0){a} {b} {c}",
        ])

    def local(self) -> str:
        a, b, c = self.digits_of(3), self.digits_of(3), self.digits_of(4)
        return self.rng.choice([
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"0{a} {b}{c}", f"0{a}/{b}{c}",
            f"0{a[0]} {b[:2]} {c[:2]} {c[2:]} {a[1:]}", f"00{a[:2]} {b} {c}", f"{a}.{b}.{c}",
        ])

    def card(self) -> str:
        number = _luhn("4" + self.digits_of(14)) if self.rng.random() < 0.8 else _luhn("37" + self.digits_of(12))
        sign = self.rng.choice(["", "", "", " ", "-", "."])
        return sign.join(number[k:k + 4] for k in range(0, len(number), 4))

    def host(self) -> str:
        return f"{self.word()}{self.rng.choice(['', '', self.small()])}"

    def email(self) -> str:
        return f"{self.word()}{self.rng.choice(['', '.', '_'])}{self.two()}@{self.host()}.{self.top()}"

    def top(self) -> str:
        return self.rng.choice(["com", "org", "net", "de", "fr", "es"])

    def at(self) -> str:
        at = self.rng.choice([" at ", " (at) ", " [at] ", "(at)", "[at]", " AT ", "{at}"])
        dot = self.rng.choice([" dot ", " (dot) ", " [dot] ", "(dot)", "[dot]", " DOT ", "."])
        return f"{self.word()}{at}{self.host()}{dot}{self.top()}"

    def ip(self) -> str:
        return ".".join(str(self.rng.randint(1, 255)) for _ in range(4))

    def ip6(self) -> str:
        parts = ["".join(self.rng.choices("0123456789abcdef", k=4)) for _ in range(8)]
        return ":".join(parts) if self.rng.random() < 0.5 else ":".join(parts[:3]) + "::" + parts[3]

    def street(self) -> str:
        kind = self.rng.choice(["Street", "Road", "Avenue", "Lane", "Drive", "St.", "Ave."])
        return f"{self.rng.randint(1, 999)} {self.Word()} {kind}" + self.rng.choice(["", f", {self.Word()} {self.digits_of(5)}"])

    def strasse(self) -> str:
        kind = self.rng.choice(["straße", "weg", "gasse", "platz", "allee"])
        return f"{self.Word()}{kind} {self.rng.randint(1, 199)}" + self.rng.choice(["", f", {self.digits_of(5)} {self.Word()}"])

    def rue(self) -> str:
        kind = self.rng.choice(["rue", "avenue", "place", "boulevard"])
        return f"{self.rng.randint(1, 199)} {kind} {self.Word()}" + self.rng.choice(["", f", {self.digits_of(5)} {self.Word()}"])

    def calle(self) -> str:
        kind = self.rng.choice(["Calle", "Avenida", "Plaza"])
        return f"{kind} {self.Word()} {self.rng.randint(1, 199)}" + self.rng.choice(["", f", {self.digits_of(5)} {self.Word()}"])

    def ssn(self) -> str:
        return f"{self.digits_of(3)}-{self.digits_of(2)}-{self.digits_of(4)}"

    def passport(self) -> str:
        return self.rng.choice("ABCXYZ") + self.digits_of(8)

    def iban(self) -> str:
        country, account = self.rng.choice(["DE", "FR", "ES", "IT"]), self.digits_of(18)
        letters = "".join(str(int(c, 36)) for c in account + country)
        number = f"{country}{98 - int(letters + '00') % 97:02d}{account}"
        sign = self.rng.choice(["", " "])
        return sign.join(number[k:k + 4] for k in range(0, len(number), 4))


def marked(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """(text, spans) of a line with brackets."""
    text, spans, at = "", [], 0
    for m in _PART.finditer(line):
        text += line[at:m.start()]
        spans.append((len(text), len(text) + len(m[1]), m[2]))
        text, at = text + m[1], m.end()
    return text + line[at:], spans


def labelled_rows(repeats: int = REPEATS, seed: int = 1) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of every template, `repeats` times. Spans are (start, end, kind), code points."""
    values = _Values(random.Random(seed))
    out = []
    for template in TEMPLATES.strip().split("\n"):
        for _ in range(repeats):
            # Brackets of values must not be read as marks, so slots are filled after marking.
            text, spans, at, shift = "", [], 0, []
            plain, marks = marked(template)
            edges = {k for a, b, _ in marks for k in (a, b)}
            for m in re.finditer(r"\{(\w+)\}", plain):
                text += plain[at:m.start()]
                shift.append((m.start(), len(text)))
                text += getattr(values, m[1])()
                shift.append((m.end(), len(text)))
                at = m.end()
            text += plain[at:]
            place = {}
            for edge in edges:
                before = max((s for s in shift if s[0] <= edge), default=(0, 0))
                place[edge] = before[1] + edge - before[0]
            spans = [(place[a], place[b], kind) for a, b, kind in marks]
            out.append((text, spans))
    return out
