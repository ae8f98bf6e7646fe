"""The labelled table for personal information: sentences with typed slots, and how the slots are filled.

Each line is one labelled example of office mail; ``{P}`` stands for a person,
``{G}`` for a given name alone, ``{E}`` an address of e-mail, ``{T}`` a
telephone number, ``{I}`` a person's own number, ``{A}`` a street address.
``{#}`` is any other number and ``{W}`` any other noun; both are outside.
Names come from a pool; numbers are drawn in the formats listed below.
"""

from __future__ import annotations

import random
import re
import unicodedata

LINES = """
Hi {G},| |We got the {W} on {#}.
Dear {G},| |{O} asked for a {W}.
Dear all,| |The {W} was closed.
Hello {G}| |My guess: the {W} got lost.
Good morning {G} -| |The {W} is partial.
Good morning {P} -| |As agreed, the {W} goes to the board.
Liebe {G},| |Das Gefrierfach im Keller ist wieder voll.
Liebe all,| |{O} fehlen noch {#} Loci.
Hallo {G},| |Gibt es schon Neuigkeiten von {O}?
Hola {G}:| |El congelador está lleno otra vez.
Estimada {G}:| |La muestra se revisó ayer.
Bonjour {G},| |Le congélateur est de nouveau plein.
Chère {G},| |Avez-vous des nouvelles de {O} ?
{G},| |Could you have a look at the {W} and tell me whether it was closed?
: {G},
> all,| > The {W} was opened.
Kind regards|{P}
Kind regards|{P}|{O}|{T}|{A}
Best,|{G}| |{P}|{O}|tel/fax {T}|{E}
Thanks,|{P}|{P}|{O}|Tel. {T}
Cheers|{G}| |{P}|{O}|T {T}|{A}
--|{P}|{O}|Phone: {T}|{A}|{E}
--|{G}
Un saludo,|{P}|{O}|Tel. {T}
Saludos|{G}
Mit freundlichen Grüßen|{P}|{O}|Tel. {T}|{A}
Viele Grüße|{G}
Cordialement,|{P}
Bien à vous|{G}|{T}
{P}|{O}|{A}
{P}|{O}|{T}|{E}
{P}|{O}|{E}
{P}|{O}|{T}|{A}|{E}
Am {D} schrieb {P}:
On {D}, {P} wrote:
On {D}, {P} <{E}> wrote:
{P} <{E}> wrote:
> From: {P}|> Dear {G},
: From: {P}|: Hello {G}
-----Original Message-----|From: {P}|To: {P}|Subject: {W} {#}
From: {P} <{E}>
From: {E}
From: {E} ({P})
To: {P} <{E}>, {P} <{E}>
To: <{E}>, {E} ({P}),|"{F}" <{E}>
To: {E}
To: "{F}" <{E}>|Subject: RE: the {W} {#}
Cc: "{F}" <{E}>, {P} <{E}>
from: {P} <{E}>|To: <{E}>
To: undisclosed-recipients
Subject: Re: {W} {#} / next steps|Date: {D}
Subject: FW: your {W} {#}|From: "{F}" <{E}>
Subject: AW: minutes: {W} {#}|from: {P} <{E}>
Message-ID: <{X}.0-0-{#}@{H}>
Message-Id: <{X}.0-3-{#}@{H}>|In-Reply-To: <{X}.0-2-{#}@{H}>
References: <{X}@lost.{H}>| <{X}.0-1-{#}@{H}>| <{X}.0-0-{#}@{H}>
Received: from {H} ([192.0.2.{#}]) by mx1.{H}| with ESMTP id {X}
List-Id: <core-{#}.lists.{H}>
Content-Type: multipart/mixed;| boundary="----=_{X}"
------=_{X}|Content-Type: text/plain; charset=utf-8|Content-Transfer-Encoding: quoted-printable
Content-Type: image/png; name="{W}_{#}.png"|Content-Transfer-Encoding: base64
Content-Disposition: attachment; filename="{W}_{#}.pdf"
<html><body style="font-family:sans-serif">|<p>Dear {G},</p>|<p>Ask {P} about the <b>old</b> {W}.</p>
<p>Kind regards<br>{G}</p>|</body></html>
<p>--<br>{P}<br>{O}<br>{T}<br>{A}</p>
<div class="m">{G},<br></div>|<p>The {W} is <b>local</b>.</p>
<p>Thanks,<br>{P}</p>
Ask {P} about the old scheme.
Ask {J} {P} about the old scheme.
According to {P} the plate never arrived.
According to {J} {P} the {W} never arrived.
Both {P} and the trainee were out.
Both {J} {P} and the trainee were out.
Both the {W} and its older {W} were signed.
The badge of {P} was found in the lift.
The badge of {J} {P} was found in the lift.
The {W} of {P} was closed. {O} asked for one.
I spoke with {P} and with {P} at the annex.
I spoke with {P} and with {J} {P} at the annex.
{P} will take over the {W} from {#}.
{P} has moved to {A} last month.
{P} now uses {E} for the lab.
{P}, born in May, ID {I}, may enter the annex.
You can reach {P} under {T} until six.
HR lists {P} under {I} (national register).
HR lists {J} {P} under {I} (national register).
cc {P} and the {W}.
cc {P}|As agreed, the {W} goes to the board.
Frau {P} kommt erst am Montag.
Herr {P} kommt erst am Montag.
Bitte mit {P} abstimmen.
Pregunten a {P}.
Demandez à {P}.
Mme {P} arrive lundi. La señora {P} llega el lunes.
Die Steuer-ID von {P} lautet {I}.
Tel {T}, ask for {P}.
My new extension is {T}.
Call {T} if the door is locked.
He left {T} on the answering machine.
Mobile: {T}
Phone: {T}|{W} was closed.
Sie erreichen mich unter {T}.
Me pueden llamar al {T}.
Vous pouvez me joindre au {T}.
Tel. {T}
tel/fax {T}|The views in this mail are those of the writer.
T {T}|{O}
Driving licence {I} was scanned by mistake.
My tax number {I} is missing on the travel form.
The access form needs a national id, mine is {I}.
For the visitor badge: personal id {I}.
Please quote to fix insurance number {I}.
They need your help to fix insurance number {I}. Do we know why?
Passport no. {I} expires in May.
Social security number on file: {I}
Ausweisnummer: {I}
Documento de identidad n.º {I}
Numéro de carte d'identité : {I}
Please send the parcel to {A} instead.
The address for the courier: {A}
address for the courier: {A}|Thanks,|{P}
The spare key is kept at {A} with {P}.
Meine neue Anschrift ist {A}.
La nueva dirección es {A}.
Ma nouvelle adresse est le {A}.
Write to {E}, not to the old box.
Please copy {E} on the next mail.
Contact: {E}
Bitte an {E} schreiben.
Escriban a {E}
Merci d'écrire à {E}
See https://wiki.orlanth.example/{W}/{#} for the broken {W}.
Freezer key {I1} opens the missing {W}.
Charge account {I2} for the {W}.
The {W} sits in box {I5} next to the shared {W}.
Catalogue number 0{#2}-{#3}-KX is approved.
Lot {I6} of the {W} expires in {#}.{#2}.
Accession SAM-00{#4} and the {W} belong together, tracking code {#10}-{#4}.
belong together, tracking code {#9}-{#3}. Run {I3} was opened on Monday.
Run {I3} was closed. Both the {W} and its {W} were moved.
Barcode 00999{#7} cannot be read on the {W}. Barcode 00999{#6} cannot be read.
Grid cell {#3}.{#3}.{#3} of the {W} is empty.
I attach the {W}; please ignore the {W} from {#2}. I attach the weekly {W}; please ignore the {W} from {#}.
Since the {W} was signed, no short {W} came in. It turned out that the {W} had been closed again.
Do we know why the {W} was exported overnight? I would rather keep the {W} than lose the {W}.
They will need the {W} before the {W} can be logged. Two {W} samples from {O} were rerun.
{O} delivered {#2} crates. The {W} from {O} is late, see ticket {#2}.
After the {W} was renamed we saw {#2} urgent loci in {B}. Thanks for the {W}! Nobody here moved it.
Date: {D}
Date: {#10}|From: {P} <{E}>
Date: unknown|Message-ID: <{X}.0-{#}-{#}@{H}>
Date: {D}|Message-ID: <{X}.0-{#}-{#}@{H}>
Date: {D}|Subject: {W} {#}|MIME-Version: 1.0
Subject: URGENT old {W} {#}|Date: {D}
Subject: Re: Re: Fwd: second {W} {#}|Date: {D}|List-Id: <{W}-{#}.lists.{H}>
Date: {D}|From: {P} <{E}>|Subject: minutes {#}
To: {P} <{E}>|Date: {D}
Cc: {P} <{E}>|Message-Id: <{X}.0-{#}-{#}@{H}>|To: {E} ({P})
In-Reply-To: <{X}.{#}-{#}-{#}@{H}>|References: <{X}.{#}-{#}-{#}@{H}>| <{X}@lost.{H}>
References: <{X}.{#}-{#}-{#}@{H}>
 <{X}.{#}-{#}-{#}@{H}>|From: {P} <{E}>
Received: from {H} ([192.0.2.{#}]) by mx{#}.{H}| with ESMTP id {X}|From: {P} <{E}>
¿Hay noticias de {O}? ¿Hay noticias de {O}? Encontramos el resultado antes del viernes. ¿Hay respuesta sobre el contrato?
La tabla sigue abierta. ¿Hay noticias de {O}?|Gracias
{G},| |{P} sent the {W}.
Best,|{G}| |{P}|{O}|{T}
Kind regards|{G}| |{P}|{O}|{A}|{E}
Cheers|{P}| |{P}|{O}|tel/fax {T}
Hi {G},| |In {B} the {W} covers {#2}.{#2} percent of the {W}.
<p>{G},</p>|<p>Please send {#2} tubes @ {#}.{#2} each.</p>
<p>Hi {G},</p>|<div class="m">No news about the {W}.<br></div>
{O}|T {T}|{E}| |{P} <{E}> wrote:
{P}|{O}|{A}|{G}
My tax number {I5b} is missing. Driving licence {I5b} was scanned. The {W} sits in box {I5}.
Social security number on file: {I5b} Passport no. {I5b} expires in May. mine is {I5b}.
born in May, ID {I5b}, may enter. fix insurance number {I5b}. The {W} sits in box {I5} next to the {W}.
{O}|{A}|{E}
Pasaporte {I} caduca en mayo.
Reisepass {I} ist abgelaufen. Passeport {I}
Voyez avec {P}. Consulten con {P}.
|{G}
|{P}
{P}|{P}|{O}|T {T}|{A}
Invoice {#6} was copied; the amount on the {W} is partial. Invoice {#5} was closed.
Order no. {#2}-{#4}-K for the {W} was signed. Order no. {#2}-{#3}-K for the {W} was closed.
Host 198.51.100.{#2} dropped the {W} at {#2}:{#2} again.
Our build tool pkg@1.{#2}.0 broke the {W} twice.
Please send {#2} tubes @ {#}.{#2} each with the old {W}.
In {B} the {W} covers {#2}.{#2} percent of the {W}, up from {#2}.
For {B} the partial scheme has {#2} loci and the {W} has {#2}.
Für {B} fehlen noch {#2} Loci. Para {B} faltan todavía {#2} loci.
The {W} from {O} shows {#2} differences, so the {W} stays at level {#2}.
Two shared samples from {O} were thawed together with the {W}.
{O} asked for a short {W}; The new trainee opened one today.
Old Kiln Works delivered {#2} crates at the annex.
Line {#2} of the {W} reads "routine {W}", which cannot be right.
Regarding the late {W}: My colleague checked it today, see ticket {#2}.
If the {W} fails {#2} times, use the long {W} instead. Thanks for the {W}!
No news about the {W} or the quiet {W}. Somebody moved it overnight.
Who owns the stale {W} in room {#2}, the one next to the {W}?
CONFIDENTIAL - contents may be privileged. Printing is discouraged. No contract is formed by e-mail.
Diese Nachricht ist vertraulich. Falls Sie nicht der Empfänger sind, löschen Sie sie bitte.
Ce message est confidentiel et destiné à son seul destinataire.
The views in this mail are those of the writer and need not be those of the institute, its boards or its partners.
Scanned for viruses. This mail was sent from {O}.
Der Lauf mit {#2} Platten war leider unvollständig. Wir haben Vertrag gefunden, der nicht passt.
Vielen Dank für die schnelle Antwort zum Auftrag. Bitte schickt uns den Bericht bis Freitag.
La serie de {#2} placas quedó incompleta. Muchas gracias. Encontramos el pedido en el sótano.
Le lot a été vérifié hier et le tableau reste ouvert. La série de {#2} plaques était incomplète.
Answer in one sentence: Explain why the {W} circles. If the {W} costs {#2} coins, what does the {W} cost?
From the valley a traveller sees the {W}; {#2} hours later the {W} lifts. Which {W} gathers the {W} first?
Suppose that every {W} near the delta follows exactly {#2} times. (A) the {W} (B) the hollow {W}
Task: A {W} is placed beside a {W} for {#2} minutes. Read the passage and pick one answer.
"""

WORDS = "report sample locus scheme audit folder table plate tube freezer meeting pipeline allele budget tree branch profile script ticket printer courier kit rack agenda survey invoice".split()
ORGANISATIONS = "Orlanth Hospital|Nimbel Diagnostics|Fjord Genomics|Tanwick Labs|Solmar Reference Unit|Kelvora Typing Centre|Corvin Medical|Haldane Field Station|Brunnfeld Institute|Ysmere Public Health|Northgate College|Ridge Valley Clinic|City Council".split("|")
SPECIES = "Tansia velox|Braccia alba|Hyloria sp.|Orrhelia minor|Myxotena lenta|Velobacter tansii|Quadribacter ruber|Cymobacter novus|Selena crassa".split("|")
HOSTS = "ux7.test|mail.orlanth.example|post.ysmere.example|kelvora.example|q-typing.test|dept3.pertania-uni.example|tanwick-labs.example|haldane-inst.invalid|web.drossel.example|brunnfeld.example|nimbel.example".split("|")
PLACES = "Juniper|Copper|Larkfield|Harrow Mill|Old Kiln|St. Orla|Quillan|Weiden|Tormes|Vesper|Brunn|Alderwick|Saltmarsh|Pilgrim|Fontenelle|Birch|Station|Mill|Church|Victoria|Linden".split("|")
TITLES = "Prof. Dr|Prof.|Dr.|Dr|Ms|Mr|Mrs|Mme|Frau|Herr|Prof".split("|")
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
#: used only where the archive's own headers name too few people
FALLBACK = [("Anna", "Keller"), ("Jonas", "Meyer"), ("Maria", "Lopez"), ("Peter", "O'Brien"), ("Claire", "van Dyck"), ("Ivan", "Petrov"), ("Lucia", "de Rossi"), ("Omar", "al-Hadi"), ("Emma", "Lindqvist"), ("Paul", "Dupont")]


class Filler:
    """Draws slot values; every draw comes from one seeded generator."""

    def __init__(self, people: list[tuple[str, str]], seed: int = 11):
        self.r = random.Random(seed)
        self.people = people if len(people) >= 40 else people + FALLBACK

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def given(self) -> str:
        return self.r.choice(self.people)[0]

    def family(self) -> str:
        return self.r.choice(self.people)[1]

    def person(self) -> str:
        g, f, x = self.given(), self.family(), self.r.random()
        if x < 0.52:
            return f"{g} {f}"
        if x < 0.64:
            return f"{f}, {g}"
        if x < 0.72:
            return f"{g[0]}. {f}"
        if x < 0.80:
            return f"{f.upper()} {g}"
        return g if x < 0.90 else f

    def email(self) -> str:
        r = self.r
        g, f, h = self._plain(self.given()), self._plain(self.family()), r.choice(HOSTS)
        local = r.choice([f"{g}.{f}", f"{g}-{f}", f"{f}.{g}", f"{g[:1]}{f}", f"{g}{r.randint(100, 999)}", f"{f}_{g[:1]}{r.randint(2, 99)}"])
        if r.random() < 0.12:
            local += r.choice(["+lab", "+news", "+alerts"])
        x = r.random()
        if x < 0.12:
            local = "".join(p[:1].upper() + p[1:] if i == 0 or r.random() < 0.6 else p for i, p in enumerate(re.split(r"(?<=[._-])", local)))
        if x < 0.68:
            return f"{local}@{h}"
        if x < 0.76:
            return f"{local}@{h}".upper()
        if x < 0.84:
            return f"{local}(at){h}"
        if x < 0.88:
            return f"{local} (at) {h}"
        return f"{local} [at] {h.replace('.', ' [dot] ')}" if x < 0.94 else f"{local} AT {h.replace('.', ' DOT ')}"

    @staticmethod
    def _plain(s: str) -> str:
        s = "".join(c for c in unicodedata.normalize("NFD", s) if c.isascii())
        return s.lower().replace(" ", "").replace("'", "").replace("-", "")

    def phone(self) -> str:
        r, d = self.r, self.digits
        area = f"0{r.randint(3, 9)}{r.randint(0, 9)}"
        s = r.choice([
            f"+999{d(8)}", f"+999{d(9)}", f"+999 {d(4)} {d(4)}", f"+999/{d(8)}", f"(+999) {d(4)}-{d(4)}", f"+999 {d(2)} {d(2)} {d(2)} {d(2)}",
            f"+999-{d(2)}-555-01{d(2)}", f"+999 {d(2)} 555 01{d(2)}", f"+999-{d(3)}-{d(5)}", f"00 999 {d(3)} {d(5)}", f"00 999 {d(2)} 555-01{d(2)}", f"00999.{d(4)}.{d(4)}",
            f"0990 / {d(3)} {d(5)}", f"0990.{d(3)}.{d(3)}", f"0990-{d(6)}", f"0 990 {d(6)}", f"(0990) {d(2)} {d(2)} {d(2)}", f"{area}.555.01{d(2)}", f"{area} 55501{d(2)}", f"{area}/55501{d(2)}", f"{area} 55 50 1{d(1)} {d(1)}", f"({area}) 555 01 {d(2)}", f"({area}) 55501{d(2)}",
        ])
        return s + (r.choice([f" ext. {r.randint(2, 99)}", f" x{r.randint(100, 999)}"]) if r.random() < 0.15 else "")

    def number(self, form: str = "") -> str:
        r, d = self.r, self.digits
        forms = {
            "1": f"P{d(7)}", "2": d(11), "3": f"{r.choice(['19', '20'])}{d(2)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}-{d(4)}", "4": f"{d(3)}-{d(2)}-{d(4)}",
            "5": f"Q{r.choice('XYZ')} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", "6": f"{d(2)}-{d(6)}-{r.choice('KTRSXW')}", "7": f"{d(3)}.{d(3)}.{d(3)}-{d(2)}",
        }
        return forms[form or r.choice("1234567")]

    def street(self) -> str:
        r = self.r
        n, p = r.randint(2, 240), r.choice(PLACES)
        return r.choice([
            f"{n} {p} Lane", f"{n} {p} Road, Flat {r.randint(1, 40)}", f"{n}-{n + 2} {p} Avenue", f"{n}B {p} St., Apt. {r.randint(1, 70)}", f"House {n}, {p} Close", f"{n} rue de {p}",
            f"Calle {p} {n}, 2º {r.choice('ABC')}", f"{p}weg {n}", f"{p}straße {n}a", f"P.O. Box {self.digits(r.randint(3, 4))}, {p}",
        ])

    def date(self) -> str:
        r = self.r
        d, m, y = r.randint(1, 28), r.randint(0, 11), r.randint(2010, 2025)
        day, clock = r.choice("Mon Tue Wed Thu Fri Sat Sun".split()), f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}"
        return r.choice([
            f"{d}.{m + 1}.{y}", f"{d} {MONTHS[m]} {y}", f"{day}, {d} {MONTHS[m]} {y} {clock}:{r.randint(0, 59):02d} {r.choice('+-')}0{r.randint(0, 9)}00", f"{d:02d}/{m + 1:02d}/{y % 100} {clock}",
            f"{y}-{m + 1:02d}-{d:02d}T{clock}:{r.randint(0, 59):02d}Z", f"{day} {MONTHS[m]} {d} {clock}:{r.randint(0, 59):02d} {y}", f"{day}, {d} {MONTHS[m]} 0{self.digits(3)}",
        ])

    def slot(self, name: str) -> tuple[str, str]:
        """(text, kind); kind is empty where the text is outside."""
        r = self.r
        if name == "P":
            return self.person(), "person"
        if name == "G":
            return self.given(), "person"
        if name == "F":
            return f"{self.family()}, {self.given()}", "person"
        if name == "E":
            return self.email(), "email"
        if name == "T":
            return self.phone(), "phone"
        if name == "I":
            return self.number(), "idno"
        if name == "I5b":
            return self.number("5"), "idno"
        if name[0] == "I":
            return self.number(name[1]), ""
        if name == "A":
            return self.street(), "street"
        if name[0] == "#":
            return self.digits(int(name[1:] or r.randint(1, 4))), ""
        if name == "X":
            return "".join(r.choice("0123456789abcdef") for _ in range(r.choice([10, 12, 13, 14, 15]))), ""
        return {"W": lambda: r.choice(WORDS), "O": lambda: r.choice(ORGANISATIONS), "B": lambda: r.choice(SPECIES), "H": lambda: r.choice(HOSTS), "J": lambda: r.choice(TITLES), "D": self.date}[name](), ""


def examples(people: list[tuple[str, str]], copies: int = 24, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled texts: (text, spans) with spans (start, end, kind); neighbouring lines are joined into longer texts."""
    fill = Filler(people, seed)
    lines = [line for line in LINES.strip().split("\n") if line]
    out = []
    for _ in range(copies):
        order = lines[:]
        fill.r.shuffle(order)
        for a in range(0, len(order), 3):
            text, spans = "", []
            mark = fill.r.choice(["", "", "", "", "> ", "| ", ": ", "> > ", ">"])
            for line in order[a : a + 3]:
                if text:
                    text += fill.r.choice([" ", "\n" + mark, "\n\n" + mark])
                for piece in re.split(r"(\{[^}]*\}|\|)", line):
                    if piece == "|":
                        text += "\n" + mark
                    elif piece.startswith("{"):
                        value, kind = fill.slot(piece[1:-1])
                        if kind and fill.r.random() < 0.12:
                            value = value.replace(" ", "\n" + mark, 1)
                        if kind == "person" and fill.r.random() < 0.06:
                            value = value.encode("utf-8").decode("cp1252", "replace")
                        if kind:
                            spans.append((len(text), len(text) + len(value), kind))
                        text += value
                    else:
                        text += piece
            out.append((text, spans))
    return out
