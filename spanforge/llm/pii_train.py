"""Training of the weights on sentences made here, with known spans.

``python -m spanforge.llm.pii_train`` writes ``pii_weights.py``. The sentences
are general ones of mail, notes, forms and logs, written for this purpose; the
names come from one half of the lexicon or are made of syllables, streets and
mail addresses from short lists, numbers by their public formats. About as many
sentences hold look-alikes: titles, products, counts, dates, codes. Part of the
words lose their class (``HIDDEN``), so that endings, shape and context are
learnt as well. ``SENTENCES`` is the documented bound of the sample.
"""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

from spanforge.functions.tokens import verhoeff_valid
from spanforge.llm import lexicon

SENTENCES = 9000
EPOCHS = 6
RATE, DECAY = 0.3, 1e-4
HIDDEN = 0.3

ONSET = "B Br C Ch D Dr F G Gr H J K Kr L M N P Pr R S Sch St T Tr V W Z Th Kh Ng Mb Sz".split()
NUCLEUS = "a e i o u ai ea ou ie ia uo ee aa ö ü é".split()
CODA = "n r l s t m k nd rt ld ng sh ck x lt mp rn ss tt".split()
ROADNAMES = "Main High Church Park Elm Oak Maple Cedar Pine Washington Lincoln Mill Station Victoria Queens Kings School Market Bridge Chestnut Walnut Highland Sunset Lakeview Willow Harbour Orchard Castle North South Pleasant Franklin Jefferson Cherry Meadow Abbey Priory Manor Garden Baker Fleet Pennsylvania Wilshire Ocean Union Liberty".split()
GERMAN = "Haupt Bahnhof Garten Schul Berg Wald Linden Goethe Schiller Mozart Kirch Dorf Mühlen Friedrich Kaiser Rosen Ahorn Birken Park See Hafen Markt Brunnen König Feld".split()
ROMANCE = "Mayor Colón Goya Serrano Roma Garibaldi Mazzini Dante Verdi Liberdade Augusta Cervantes Alcalá Molière Voltaire Pasteur Foch Rivoli Gambetta Zola Moulins Hugo Paix Fleurs Sol Luna Toledo Bilbao".split()
MAILWORDS = "contact office dana ruiz kowal petrov sunny maple rocket quiet delta marco paul anne lopez billing hr ceo".split()
PLAIN = (
    "The invoice came to {n} euros and {n} cents.", "We counted {n} of {n} boxes on shelf {d1}.", "Your reference is {code}.", "Tracking code {code} was scanned twice.", "Part no. {code} is out of print.", "Serial number {code}, revision {d1}.", "See ISBN 978-{d1}-{d3}-{d5}-{d1}.",
    "Card ending {d4}; full number {d4} {d4} {d4} {d4} was declined.", "Meeting on {date} at {d2}:{d2}.", "Between {date} and {date} nothing happened.", "Version {d1}.{d2}.{d1} of {cap} {cap} is out.", "Server 10.{d2}.{d3}.{d1} did not answer.", "Order {bad12} has left.", "Number {bad} is not valid.", "Booking {d6} for {n} nights.", "The id {bad} was rejected.",
    "{cap} {cap} opens on {day}.", "Read {cap} {cap} by page {n}.", "{cap} {cap} {cap} won again.", "Our {cap} {cap} team is hiring.", "{place} {cap} is closed.", "Flights to {place} {place} are late.", "Welcome to {cap} {cap}!", "The {cap} {cap} plan costs {n}.", "{cap} {cap}, level {d1}.", "Join the {cap} {cap} at {n} sharp.", "Go to {cap} {cap} > {cap}.", "{giv} {cap} is our new scent.", "{giv} {place} station, exit {d1}.", "{cap} {sur} launched version {d1}.", "{cap} {unk} Suite {d1} is ready.", "{unk} {cap} updated.", "Terms of {unk} {cap} apply.",
    "In {place} it rained. {cap} was cold.", "The {low} is {let}. {cap} is full.", "Take {low} {let}. {cap} {n} helps too.", "We use {low} {let}. {unk} {low} it.", "see annex {let}. {cap} {low}", "The {low} is {let}. {acr} is {low}.", "{acr} {acr} and {cap} {acr}", "It was late. {cap} {low} was {low}.", "{cap} {n} and {cap} {n} were swapped.", "{cap} {low} {n} {low}. {cap} {low} {low} {n}.",
    "Room {n} {cap} Court is booked.", "Chapter {d1} {cap} Road ends here.", "Exit {d2} {cap} Street closed.", "Screen {d2} {cap} Lane view broken.", "Top {d2} {cap} Drive tips.", "Lot {d3} {cap} Place sold.", "Channel {d1} {cap} Square show.", "Level {d2} {cap} Avenue map.",
    "id={d6}", "order={code}", "total={n}&page={d1}", "sku={code}&qty={d1}", "title={cap} {cap}", "plan={cap} {cap} {n}", "city={place} {cap}", "theme={cap} {cap}&mode={low}", "event={cap} {cap}&day={day}", '"product": "{cap} {cap}"', '"label":"{unk} {cap}"', '{{"lot":"{code}","n":{n}}}', "<title>{cap} {cap}</title>", "<code>{code}</code>",
    "X-Trace\x1f{d6}{d6}", "X-Batch\x1f{code}", "X-Region\x1f{place} {cap}", "Server\x1f{unk}/{d1}.{d2} ({cap} {cap} {d1})", "User-Agent\x1f{unk}/{d1}.{d1} ({cap}; {cap} {cap} {d2}_{d1} like {cap} {cap} X)", "Content-Length\x1f{d4}", "/orders/{d6}", "/files/{code}.pdf", "/docs/{cap} {cap}", "Follow @{low}_{low} now.", "Install {low}@{d1}.{d2}.{d1} today.", "Use {low}@{low} for ssh.", "Set {low}={n}; {low}={date}.",
    "{date} {d2}:{d2}:{d2}", "Cells {d2}-{d2}-{d2} to {d2}-{d2}-{d2}.", "Scores: {d1}-{d1}, {d2}-{d2}, {d1}-{d1}.", "Values {d3} {d3} {d3} {d3} and {d2} {d2} {d2}.", "lat {d2}.{d5} lon {d2}.{d5}", "IBAN DE{d2} {d4} {d4} {d4} {d4} {d2}", "epoch {d6}{d4}", "at {d6}{d6}{d1} ms",
)
CARRIERS = {
    "person_name": (
        "{x} will present the quarterly figures.", "Did {x} pay?", "Has {x} left?", "Will {x} join us?", "When {x} called, we were out.", "Yesterday {x} came by.", "Since {x} left, all is quiet.", "My name is {x}.", "I met {x} at the fair.", "Thanks, {x}", "Kind wishes, {x}", "Best, {x}", "Hi {x}, could you check this?", "Hello {x},", "Sehr geehrte Frau {x}", "Herr {x} hat gestern angerufen.", "Madame {x} souhaite un rendez-vous.", "El señor {x} llamó ayer.", "La dottoressa {x} ha confermato.", "{x} asked for a copy.", "{x} wrote:", "Assigned to {x}", "reviewed by {x} on {day}", "author: {x}", "Patient {x} was admitted.", "cc {x}", "signed, {x}", "the file of {x} was closed", "{x} and the rest agreed.", "According to {x}, it works.", "Ask {x} instead.", "{x}'s passport ran out", "an interview with {x}", "Le dossier de {x} est prêt.", "Das Paket ist für {x}.", "Firmado por {x}.", "Met with {x} on {day}. All fine.", "We owe {x} {n} euros.", "{cap} {low} {low}. {x} {low} it. {cap} {low}.", "{cap} {n} {low}. Then {x} came.",
        "employee={x}", "fullname={x}&age=40", '"customerName": "{x}"', '{{"author":"{x}","n":{n}}}', "<contactPerson>{x}</contactPerson>", "X-Author\x1f{x}", "Display-Name\x1f{x}", "/users/{x}/profile", "/people/{x}", "/find/{x}", "/reports/by/{x}.pdf", "owner={x};tier=2", "note={x} agreed", "q={x}", '"v":"{x}"', "a=1; user={x}; b=2", "{x}: fine with me", "({x})", "{x}, {day}",
    ),
    "phone": (
        "You can call me at {x}.", "My number is {x}", "Tel. {x}", "T: {x}", "Fax {x}", "Mobile: {x}", "Please dial {x} and ask for sales.", "Text me on {x}", "WhatsApp {x}", "Telefon: {x}", "Ich bin erreichbar unter {x}.", "Appelez le {x} demain.", "Mi teléfono es {x}", "Chiamami al {x}", "We tried {x} two times, no answer.", "She gave {x} as her number.", "The line {x} is dead.", "{x} is my new cell", "Numéro : {x}", "Parcel {n}. {x}, after six.",
        "phone_number={x}", '"tel":"{x}"', "contact={x}", "X-Phone\x1f{x}", "/call/{x}", "/people/{x}/calls", "q={x}", "sms={x}&text=ok", "<mobile>{x}</mobile>", "tel:{x}", "uri\x1ftel:{x}",
    ),
    "email": ("Write to {x}.", "Mail me: {x}", "E-Mail: {x}", "{x} bounced", "cc={x}", "Reply-To\x1f{x}", '{{"user":"{x}"}}', "/accounts/{x}/reset", "<mail>{x}</mail>", "({x})", "login {x} failed", "mailto:{x}", "Moi c'est {x}, merci."),
    "national_id": (
        "SSN: {x}", "My social security number is {x}.", "PAN card {x} was seen.", "Aadhaar {x} was verified.", "Identity number {x}", "Passport or ID: {x}.", "Taxpayer {x} filed late.", "Numéro d'identité {x}", "We hold {x} for her.", "Verification of {x} failed.", "{x} is on the form", "Is {x} yours?", "no. {x} belongs to her", "The number {x} was copied by hand.",
        "ssn_number={x}", '"nationalId":"{x}"', "X-Ssn\x1f{x}", "aadhaar={x}", "uid {x} on record", "/citizens/{x}", "q={x}", "<taxId>{x}</taxId>", '"v": "{x}"', "X-Subject\x1f{x}",
    ),
    "street_address": (
        "Send it to {x}, {place}.", "Bring it to {x}, {unk}.", "{x}, {cap} {low}", "They rented {x} for a year.", "We left {x} in May.", "I know {x} well.", "He sold {x} and moved.", "Paint {x} first.", "I live at {x}.", "Our office is now in {x}.", "Ship it to {x}, please.", "Billing address: {x}", "The shop on {x} is closed.", "Wohnhaft {x}", "J'habite {x} depuis mai.", "Vive en {x}", "Abita in {x}", "Meet me outside {x}.", "{x} is where we grew up.", "Please use {x} from now on, not the old one.", "Die Firma sitzt {x}.", "It went to {x} by mistake.", "Visit us: {x}!", "Parcel {n} for {x}.",
        "address={x}", '"line1": "{x}"', "<street>{x}</street>", "X-Address\x1f{x}", "/addresses/{x}", "home={x}&zip={d5}", "q={x}", '"to":"{x}"',
    ),
}


def _half(words: frozenset[str], of: int) -> list[str]:
    """Every second word in order; the other half is for tests."""
    return [w for k, w in enumerate(sorted(words)) if k % 2 == of]


class Maker:
    """Sentences with spans; ``of`` chooses the half of the lexicon, ``carriers`` and ``plain`` the texts around the spans."""

    def __init__(self, seed: int, of: int = 0, carriers: dict | None = None, plain: tuple | None = None) -> None:
        self.r = random.Random(seed)
        self.given, self.surname = _half(lexicon.GIVEN, of), _half(lexicon.SURNAME, of)
        self.ordinary, self.place = _half(lexicon.ORDINARY, of), _half(lexicon.PLACE, of)
        self.carriers, self.plain_texts = carriers or CARRIERS, plain or PLAIN

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def unknown(self) -> str:
        """A word no list has."""
        r = self.r
        w = "".join(r.choice(ONSET).lower() + r.choice(NUCLEUS) + (r.choice(CODA) if r.random() < 0.5 else "") for _ in range(r.choice((1, 2, 2, 3))))
        return w.capitalize() + ("" if r.random() < 0.5 else r.choice(lexicon.SURNAME_ENDINGS[:70]))

    def person_name(self) -> str:
        r = self.r
        cap = lambda w: "-".join(p[:1].upper() + p[1:] for p in w.split("-"))
        draw = r.random()  # many family names are given names as well
        first = cap(r.choice(self.given)) if draw < 0.74 else cap(r.choice(self.surname)) if draw < 0.82 else self.unknown()
        last = cap(r.choice(self.surname)) if r.random() < 0.45 else self.unknown()
        if r.random() < 0.12:
            last += "-" + (cap(r.choice(self.surname)) if r.random() < 0.5 else self.unknown())
        if r.random() < 0.06:
            last = r.choice(("van ", "von ", "de ", "de la ", "van der ", "di ", "da ", "al ", "bin ")) + last
        middle = r.choice("ABCDEFGHJKLMNPRSTW") + ". " if r.random() < 0.14 else cap(r.choice(self.given)) + " " if r.random() < 0.06 else ""
        way = r.random()
        glue = "" if r.random() < 0.2 else " "
        name = f"{first[0]}.{glue}{last}" if way < 0.13 else f"{last}, {first}" if way < 0.24 else f"{last}, {first[0]}." if way < 0.27 else f"{first} {middle}{last}"
        return name.upper() if r.random() < 0.08 else name

    def phone(self) -> str:
        d = self.digits
        lead = self.r.choice("23456789")
        return self.r.choice((
            f"{lead}{d(2)}-{d(3)}-{d(4)}", f"({lead}{d(2)}) {d(3)}-{d(4)}", f"({lead}{d(2)}) {d(3)} {d(4)}", f"({lead}{d(2)}){d(3)}-{d(4)}", f"{lead}{d(2)}.{d(3)}.{d(4)}", f"{lead}{d(2)} {d(3)} {d(4)}", f"+1 {lead}{d(2)} {d(3)} {d(4)}", f"+1 ({lead}{d(2)}) {d(3)}-{d(4)}", f"+1-{lead}{d(2)}-{d(3)}-{d(4)}", f"+1{lead}{d(9)}", f"1-{lead}{d(2)}-{d(3)}-{d(4)}",
            f"020 {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"+44 7{d(3)} {d(6)}", f"07{d(3)} {d(6)}", f"+4420{d(8)}", f"0044 20 {d(4)} {d(4)}", f"0{d(2)}/{d(8)}", f"0{d(3)} {d(6)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 {d(3)} {d(7)}", f"+49 (0){d(2)} {d(7)}", f"0049-{d(2)}-{d(5)}-{d(3)}", f"0049 {d(3)} {d(7)}",
            f"+33 {lead} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{lead}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{lead} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{lead}-{d(2)}-{d(2)}-{d(2)}-{d(2)}", f"+91 {lead}{d(4)} {d(5)}", f"+91-{lead}{d(9)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+34 {d(3)} {d(2)} {d(2)} {d(2)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"+81 {d(1)}-{d(4)}-{d(4)}", f"0{d(1)}-{d(4)}-{d(4)}", f"+61 4{d(2)} {d(3)} {d(3)}", f"+55 {d(2)} 9{d(4)}-{d(4)}", f"+{lead}{d(1)}{d(9)}", f"+31 6 {d(8)}", f"+46 70 {d(3)} {d(2)} {d(2)}",
        ))

    def email(self) -> str:
        r = self.r
        who = r.choice(MAILWORDS) + r.choice(("", ".", "_", "-")) + r.choice(MAILWORDS) + r.choice(("", self.digits(2))) + r.choice(("", "", "", "+x", "+shop"))
        at = r.choice(("@", "@", "@", "@", " [at] ", "(at)", " (at) "))
        return who + at + r.choice(("example.com", "post.example.edu", "mail.invalid-domain.co.uk", "Example.ORG", "uni.test.de"))

    def aadhaar(self, good: bool) -> str:
        while True:
            x = self.r.choice("23456789") + self.digits(11)
            if verhoeff_valid(x) == good:
                return x

    def national_id(self) -> str:
        r = self.r
        way = r.random()
        if way < 0.4:
            s = r.choice("-- ")
            return f"{r.choice('12345')}{r.choice('123456789')}{self.digits(1)}{s}{r.choice('123456789')}{self.digits(1)}{s}{r.choice('123456789')}{self.digits(3)}"
        if way < 0.7:
            letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
            return "".join(r.choice(letters) for _ in range(3)) + r.choice("PCHFATBLJG") + r.choice(letters) + self.digits(4) + r.choice(letters)
        x = self.aadhaar(True)
        s = r.choice((" ", "-", ""))
        return s.join((x[:4], x[4:8], x[8:]))

    def street_address(self) -> str:
        r = self.r
        n = r.choice((str(r.randint(1, 300)), str(r.randint(1, 300)), str(r.randint(300, 9999)), f"{r.randint(1, 99)}{r.choice('abcAB')}"))
        name = r.choice(ROADNAMES) if r.random() < 0.5 else self.unknown()
        german = r.choice(GERMAN) if r.random() < 0.6 else self.unknown()
        romance = r.choice(ROMANCE) if r.random() < 0.6 else self.unknown()
        kind = r.choice("Street Street Road Avenue Lane Drive Court Way Close Gardens Grove Hill Terrace Crescent Place Square Boulevard St. Rd. Ave. Ln. Row Walk Parkway Mews".split())
        return r.choice((
            f"{n} {name} {kind}", f"{n} {name} {kind}", f"{n} {name} {kind}", f"{n} {r.choice(ROADNAMES)} {name} {kind}", f"{n} {name} {kind}, Apt {r.randint(1, 60)}", f"{n} N. {name} {kind}", f"{n} {r.randint(4, 90)}th {kind}", f"{n} {name} {kind} NW", f"{n} {name.upper()} {kind.upper()}", f"{n} Broadway",
            f"{german}straße {n}", f"{german}str. {n}", f"{german}weg {n}", f"{german}platz {n}", f"{german}er Allee {n}", f"Alte {german}straße {n}", f"Am {german}markt {n}", f"{r.choice(('An der', 'Unter den', 'Auf dem', 'Zum', 'Im'))} {german} {n}", f"{german}gracht {n}", f"{german}gatan {n}", f"{german}laan {n}",
            f"{n}, rue de {romance}", f"{n} rue {romance}", f"{n} bis avenue {romance}", f"{n}, boulevard de la {romance}", f"{n} place {romance}", f"Calle {romance} {n}", f"Calle de {romance}, {n}", f"Avenida {romance} {n}", f"Plaza {romance}, {n}", f"Via {romance} {n}", f"Piazza {romance}, {n}", f"Rua {romance}, {n}", f"ul. {romance} {n}",
        ))

    def code(self) -> str:
        """Groups of digits that are no number of a person."""
        r = self.r
        while True:
            sizes = [r.randint(1, 5) for _ in range(r.randint(2, 5))]
            if sizes in ([3, 2, 4], [3, 3, 4], [4, 4, 4], [3, 4, 4]) or len(sizes) == 5 and set(sizes) == {2} or sizes[-3:] == [3, 3, 4]:
                continue
            s = r.choice("-- .//")
            groups = [self.digits(k) for k in sizes]
            if groups[0][0] == "0" and sum(sizes) > 8:
                continue
            return r.choice(("", "", "A", "LX")) + s.join(groups)

    def plain(self) -> str:
        r = self.r
        cap = lambda w: w[:1].upper() + w[1:]
        while True:
            x = self.aadhaar(False)
            c = " ".join((x[:4], x[4:8], x[8:]))
            text = r.choice(self.plain_texts)
            made = {"n": self.digits(r.randint(2, 4)), "bad12": r.choice((c, x)), "code": self.code(), "date": r.choice((f"20{r.randint(10, 30)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 30)}", f"20{r.randint(10, 30)}/{r.randint(1, 12):02}/{r.randint(1, 28):02} {r.randint(0, 23):02}")), "bad": r.choice((f"9{self.digits(2)}-{self.digits(2)}-{self.digits(4)}", c, x, f"000-{self.digits(2)}-{self.digits(4)}", f"666 {self.digits(2)} {self.digits(4)}"))}
            for k in range(1, 7):
                made[f"d{k}"] = self.digits(k)
            # each place holder of a word gets a word of its own
            for key, pool in (("cap", self.ordinary), ("low", self.ordinary), ("place", self.place), ("day", ["Monday", "Tuesday", "Friday"]), ("acr", ["".join(r.choice("ABCDEFGHIKLMNOPRSTUV") for _ in range(r.randint(2, 4)))]), ("let", list("ABCDEFGHKLMNPRSTX")), ("giv", self.given), ("sur", self.surname)):
                while "{" + key + "}" in text:
                    w = r.choice(pool)
                    text = text.replace("{" + key + "}", w if key == "low" else cap(w), 1)
            while "{unk}" in text:
                text = text.replace("{unk}", self.unknown(), 1)
            return text.format(**made)

    def sentence(self) -> tuple[str, set[tuple[int, int, str]]]:
        text, gold = "", set()
        for _ in range(self.r.randint(1, 3)):
            if text:
                text += self.r.choice((" ", "\x1e", " "))
            if self.r.random() < 0.5:
                text += self.plain()
                continue
            kind = self.r.choice(list(self.carriers))
            carrier = self.r.choice(self.carriers[kind])
            spans = [(kind, getattr(self, kind)())]
            if self.r.random() < 0.08:  # entities side by side
                other = self.r.choice([k for k in self.carriers if k != kind])
                spans.append((other, getattr(self, other)()))
            glue = self.r.choice((", ", ", ", " / ", "; ", "\n"))
            part, at = "", []
            for k, (kind_, x) in enumerate(spans):
                part += glue if k else ""
                at.append((len(part), len(part) + len(x), kind_))
                part += x
            keep, self.plain_texts = self.plain_texts, (carrier.replace("{x}", "\x00").replace("{{", "{{").replace("}}", "}}"),)
            made = self.plain()
            self.plain_texts = keep
            head, _, tail = made.partition("\x00")
            base = len(text) + len(head)
            gold |= {(base + a, base + b, k) for a, b, k in at}
            text += head + part + tail
        return text, gold


def hiding(r: random.Random, share: float):
    """A word's class, some words hidden from the lexicon throughout a sentence."""
    seen: dict[str, str] = {}

    def cls(w: str) -> str:
        if w not in seen:
            seen[w] = lexicon.classify(w, lexicon.classify(w) in "gs" and r.random() < share)
        return seen[w]

    return cls


def train(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = 1) -> tuple[dict[str, float], int]:
    """Weights that maximise the likelihood of the known segmentations, and how many spans no candidate matched."""
    from spanforge.llm.pii import candidates, link, marginals

    make = Maker(seed)
    r = random.Random(seed + 1)
    data, missed = [], 0
    for _ in range(sentences):
        text, gold = make.sentence()
        spans = candidates(text, hiding(r, HIDDEN))
        have = {s[:3] for s in spans}
        missed += len(gold - have)
        if spans and gold <= have:
            data.append((spans, [s[:3] in gold for s in spans]))
    w: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-3)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for spans, truth in data:
            _, probability, pairs = marginals(spans, w)
            grad: dict[str, float] = defaultdict(float)
            for (_, _, kind, features), p, t in zip(spans, probability, truth):
                if abs(t - p) > 1e-4:
                    for f in (f"{kind}:bias", *features):
                        grad[f] += t - p
            for (j, k), p in pairs.items():
                t = truth[j] and truth[k]
                if abs(t - p) > 1e-4:
                    grad[link(spans[j][2], spans[k][2])] += t - p
            for f, g in grad.items():
                g -= DECAY * w[f]
                squares[f] += g * g
                w[f] += RATE * g / squares[f] ** 0.5
    return {k: round(v, 3) for k, v in sorted(w.items())}, missed


def evaluate(weights: dict[str, float], make: Maker, sentences: int = 2000) -> dict[str, tuple[float, float]]:
    """(precision, recall) of whole spans by type."""
    from spanforge.llm.pii import TYPES, candidates, viterbi

    hit, said, true = defaultdict(int), defaultdict(int), defaultdict(int)
    for _ in range(sentences):
        text, gold = make.sentence()
        got = set(viterbi(candidates(text), weights))
        for k in TYPES:
            g, t = {x for x in got if x[2] == k}, {x for x in gold if x[2] == k}
            hit[k] += len(g & t)
            said[k] += len(g)
            true[k] += len(t)
    return {k: (round(hit[k] / max(1, said[k]), 4), round(hit[k] / max(1, true[k]), 4)) for k in TYPES}


def main() -> None:
    weights, missed = train()
    lines = "".join(f'    "{k}": {v},\n' for k, v in weights.items())
    Path(__file__).with_name("pii_weights.py").write_text(f'"""Weights written by pii_train; made, not edited."""\n\nWEIGHTS: dict[str, float] = {{\n{lines}}}\n')
    print(len(weights), "weights;", missed, "spans without candidate;", evaluate(weights, Maker(99, 1)))


if __name__ == "__main__":
    main()
