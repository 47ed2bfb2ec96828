"""A small table of hand-made labelled rows, and a writer that fills their places with invented values.

The rows are sentences of everyday life, from letters, counters and forms, and belong to no corpus. A place such as
{phone} is a piece of that kind; places such as {number} are filled too but aren't personal. Values follow public forms.
"""

from __future__ import annotations

import random

from millrace.llm.crf import GIVEN, words_of

KINDS = ["email", "phone", "id_number", "address", "person"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

#: Rows with personal data.
ROWS = """
Kindly forward the tickets to {email} before Friday.
{email} is where I get my bank statements
you can find me under {email} or under {email}
e-mail address {email} does not get the newsletter any more
mailbox {email} is full again
Dr. {person} prescribed it, her secretary answers at {email}
old address {email}, new one {email}
my mail ({email}) bounced twice
From: {email} To: {email}
registered as {email} since last winter
email {email}
my husband's account is {email}
Contact: {person}, {email}, {phone}
to: {email}; copy to {email}
Please ring {phone} after lunch.
the plumber's number is {phone}
You reach the surgery under {phone} all night
phone {phone} rings but nobody answers
dial {phone} for the front desk
tel {phone} or {phone}
mobile number {phone} belongs to my sister
{phone} is my new number
I texted {phone} and got no reply
Fax: {phone}
whatsapp {phone} please
landline ({phone}) is dead since the storm
leave a message at {phone}, ask for {person}
emergency contact {person} {phone}
call back on {phone}
My social security number is {id_number} and the form rejects it.
passport {id_number} expires in May
passport number: {id_number}
National insurance number {id_number}
her identity card reads {id_number}
driving licence {id_number} was stolen
tax number {id_number} is missing on the payslip
SSN {id_number}
the clinic wrote {id_number} as my patient's personal number
citizen number {id_number} belongs to {person}
residence permit {id_number}
ID: {id_number}
the border police noted passport {id_number}
health insurance id {id_number} for {person}
{id_number} is my personal identity number
id no. {id_number}, born in spring
Send the keys to {address} please.
we live at {address}
the wedding takes place at {address}
my flat, {address}, has no heating
The old shop at {address} is closed
parcel for {address} came back
Address: {address}
pick me up at {address} at noon
deliver the sofa to {address}
from {address} to {address}
they relocated to {address} in autumn
the bill still shows {address}
home address {address}
meet {person} in front of {address}
billing to {address} please
My name is {person} and I lost my umbrella.
I am {person}
this is {person} speaking
Yours sincerely, {person}
kind regards {person}
Mr {person} ordered the soup
Mrs. {person} waits in the lobby
Prof. {person} gave the lecture
ask nurse {person}
the teacher, Ms {person}, is ill
in the name of {person}
{person} forgot the passport at the desk
{person} and {person} share the room
{person} told me to come back tomorrow
I spoke with {person} about the lease
please book a table for {person}
{person} never received the parcel
the tenant is {person}
our coach {person} moved away
room was booked by {person}
signed: {person}
can {person} borrow the projector?
why was {person} charged twice
thanks {person}
dear {person},
hello {person}, how are you
invite {person} to the party
the driver was called {person}
add {person} to the guest list
new colleague: {person}
{person} here, still waiting
could you tell {person} that I am late
{person}'s bag is in the hall
written by {person} for {person}
our neighbour {person} at {address} keeps the spare key
{person} ({email}) lives at {address}
{person}, {id_number}, {phone}
{email} never hears from you
{email} doesn't open any more
{email} was typed twice
somebody reads {email} in my place
the note for {email} came back, and so did {email}
Sincerely, {person}
Cheers, {person}
Bye, {person}
Greetings, {person}
Best wishes, {person}
Love, {person} and {person}
I'm called {person}
{person} again
we're {person} and {person}
I'm {person}, the tenant upstairs
that's {person}, not {person}
the keys were given to {person} in error
handed to {person} this morning
it belongs to {person}
lent to {person} in spring
the prize went to {person} instead
{person} does not see the door code
{person} won't open the letter
{person} is not on the list
identity number {id_number} was not accepted
the number {id_number} is invalid, says the office
personal id {id_number} appears on the bill
social insurance {id_number}
my tax id is {id_number}
id card {id_number} ran out
{phone}, that's the shop
reach him by phone: {phone}
our house is {address}
now at {address}
""".strip().split("\n")

#: Rows without personal data, many with numbers and names that only look personal.
PLAIN = """
flight {letters} {number4} leaves at {time}
the parcel {letters}{number9} is stuck in customs
receipt {number7}-{number2} has the wrong date
invoice {number4}/{number5} was paid
bill no. {letters}-{number6}
booking reference {letters}{number5}
claim {number8} was rejected
reported as {letters}-{number4} last week
complaint {number6} is still open
build {number8}.{number2} crashes
firmware {version} does not start
since version {version} it is slow
update {version} broke printing
error {number4} on screen
it says error {letters}{number5}
fault code {letters}-{number3}
ISBN {number3}-{number1}-{number4}-{number4}-{number1}
serial {number4}-{number4}-{number4}
model {letters}{number3}-{number2}
lot {number6} tastes odd
open from {time} to {time}
on {date} the heating failed
valid until {date}
between {number4} and {number4} people came
about {number1} {number3} {number3} visitors a year
costs {number3}.{number2} each
{number2} % of {number5}
pages {number2}-{number3}
a table of {number3} x {number3} cm
server 10.0.{number2}.{number2} is down
port {number4} is closed
section {version} of the manual
room {number3} is cold
bus {number3} is late
seat {number2}{capital}
channel {number2} shows nothing
track {number2} skips
{number2}-{number2} children
as [email] wrote
see [phone] in the text
key [api-key] is hidden
signed [name]
number [id] removed
id={number5} in the link
population of {number7}
holds {number2} {thing}s at most
{number3} {thing}s a day
{number4} {thing}s were lost at once
with {number2} or {number3} {thing}s
{number4} x {number4} pixels
{number1} {number3} {number3} letters
{number2} {number3} {number3} rows of seats
the year {number4} brought {number3} {thing}s
{code} is the code of the {thing}
{Name} falls asleep
start {Name} with a {thing}
{Name} {Name} is our newest {thing}
why is {Name} not there
“{Name}” is too loud
the {Name} {thing}
with {Name} you can fly
open {Name}, then {Name}
{Name} and {Name} are rivers
{Name}s and {Name}s
to wash {Name}, take warm soap
to close {Name}, turn the handle and wait
to feed {Name}, whistle; to calm {Name}, sing
hi, to dry {Name}, shake it
hi, {Name} makes a strange noise
if you like {Name}, stay
so {Name} does not float
before we paint {Name} in the yard, rest
guests who tune {Name} in the cellar
walk to {Name} and turn left
go to {Common} and wait there
it rains all day
it hurts, it really does
feed {Name}, close the {thing} and go
to paint {Name}, wait for the sun
while {Name} is cold, it sleeps and it stays so
build number {number7}.{number1}
born in {number4}
order {number8} came late
order #{number6} please
purchase {number7}-{number2} was refused
{homograph} {thing} is missing
under {homograph} {thing} nothing happens
open the {homograph} {thing} first
the {homograph} {homograph} {thing} looks odd
our {place} {thing} changed colour
the {place} {thing}
behind the {place} {thing}
{Common} {thing} button
the {Common} {Common} {thing} burns
use {Common} {thing} instead
Street {thing} is wrong
Address {thing} is required
Phone {thing} shows zero
Name {thing} can't be sorted
""".strip().split("\n")

#: Given names that are common words too, things that are named after them, and places that name things.
HOMOGRAPHS = "Mark Will Grant Bill Frank Rose Iris Lily Ivy Ruby Amber Crystal Jade Pearl Olive Ginger Summer Autumn April May June August Penny Grace Hope Faith Joy Dawn Chase Drew Guy Jack Robin Sandy Dale Cliff Miles Rob Sue Pat Gene Skip Ray Max Page Clay Reed Victor Mason Hunter Carter Cooper Tanner Jasper Art Basil Violet Hazel Sterling Rusty Dusty Rich Christian Major Lance Pierce Trip Buck Duke Earl King Prince Angel Sky Star Stone River Forest Heath Glen Brook".split()
THINGS = "gallery wizard ledger board banner palette drawer toolbar gadget screen menu tab list page view panel dialog report theme mode layout template column field button section step rule release reports editor player timer counter chart map scanner printer console archive calendar".split()
PLACES = "Main Street|Park Lane|High Street|Station Road|Road|Market Square|Broad Avenue|Bay|Hill|North Gate|River Bank".split("|")
COMMONS = "Save Print Export New Old Monthly Weekly Daily Quick Shared Public Private Global Default Custom Advanced Basic Sales Finance Travel Music Photo Video Kitchen Garden Office School Winter Spring Monday Friday Complete Access Call Bank Tax Health Home Work Night Light Dark Blue Green".split()
#: Family names that are common in several countries, for the writer only.
FAMILY = "Smith Johnson Williams Brown Jones Taylor Davies Evans Walker Wright Thompson Robinson Hughes Green Hall Wood Clarke Baker Harris Turner Cooper Morris Bennett Murray Campbell Fraser Kelly Murphy Byrne Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Koch Richter Klein Wolf Schröder Neumann Zimmermann Lefebvre Moreau Dubois Laurent Girard Fontaine Rousseau García Fernández Rodríguez Sánchez Torres Navarro Castillo Ortega Rossi Ferrari Bianchi Romano Ricci Marino Silva Santos Pereira Costa Oliveira Jansen Bakker Visser Andersson Johansson Lindqvist Bergström Hansen Nilsen Larsen Nielsen Jensen Korhonen Virtanen Nowak Kowalski Wójcik Novák Dvořák Horváth Nagy Popescu Ivanov Petrov Sokolov Yılmaz Kaya Haddad Khan Patel Singh Sharma Gupta Nguyen Tran Kim Park Tanaka Suzuki Watanabe Chen Wang Okafor Mensah Diallo".split()
FILLER = "how do i can't cannot where is why does who can help please it true that so and what if when after before only the a an each every any no with without under over from to for of in on at by you we they its this that these bread train ticket kettle garden window river bicycle letter key door coat lamp engine fence market lesson soup chair ladder bottle summer winter bus shop museum old new red blue slow fast wooden broken late early again today tomorrow thanks hi hello morning not working show hide open close lock move change add remove".split()
SYLLABLES = "ba be bo da de do fa fe fi ga go ha he ho ja jo ka ke ki la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va ve vi wa we za zo".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, *of: str) -> str:
        return self.r.choice(of)

    def word(self, least: int = 2, most: int = 5) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(least, most)))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def fill(self, form: str) -> str:
        return "".join(self.digits(1) if c == "0" else self.r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c == "A" else c for c in form)

    # forms of values, as they are written in public
    def host(self) -> str:
        name = self.word() + self.one("", "", "-" + self.word(1, 2), self.one("mail", "net", "soft", "works", "post", "group", "lab"))
        return self.one("", "", "", "mail.", "mx.", "post.") + name + "." + self.one("com", "com", "org", "net", "example", "test", "invalid", "de", "fr", "io", "co.uk", "eu", "info")

    def email(self) -> str:
        first, last = self.r.choice(GIVEN).lower(), self.family().lower().replace(" ", "").replace("'", "")
        local = self.one(f"{first}.{last}", f"{first}_{last}", f"{first}-{last}", f"{first[0]}{last}", f"{first[0]}.{last}", f"{last}.{first}", f"{last}{self.digits(2)}", f"{first}{self.digits(self.r.randint(1, 4))}", f"{first}.{last}+{self.one('news', 'shop', 'x', 'test', 'work')}", first, self.word(), self.one("info", "office", "team", "kontakt"))
        kind = self.r.random()
        if kind < 0.66:
            return f"{local}@{self.host()}"
        host = self.host()
        if kind < 0.76:
            return f"{local} {self.one('(at)', '[at]', '(a)')} {host}"
        if kind < 0.86:
            return f"{local}[at]{host.replace('.', '[dot]') if self.r.random() < 0.7 else host}"
        return f"{local.replace('.', ' dot ') if self.r.random() < 0.6 else local} at {host.replace('.', ' dot ')}"

    def phone(self) -> str:
        return self.fill(self.one("+00 000 000 0000", "+00 00 000 00 00", "+00 0000 000000", "+00 00 0000 0000", "+00 0 00 00 00 00", "+00 000 00 000", "+0 000 000 0000", "+0 000 0000 000", "+0-000-000-0000", "+00000000000", "+00 00000000", "000-000-0000", "000-0000", "000.000.0000", "(000) 000-0000", "(000) 000 0000", "(00) 0000 0000", "0000 000000", "00000 000000", "00 00 00 00 00", "000 00 00 00 00", "0000000000", "0000-00-00000000", "000/0000000", "000-0000 ext. 000", "000-000-0000 x000", "000 000 0000 ext 00"))

    def id_number(self) -> str:
        # social security, insurance, personal, tax and passport numbers of several countries
        return self.fill(self.one("000-00-0000", "000-00-0000", "000 00 0000", "AA 00 00 00 A", "AA000000A", "000000-0000", "00000000A", "A0000000A", "A0000000", "AA0000000", "000000000", "00.000.000-0", "00.000.000-A", "000.000.000-00", "000.0000.0000.00", "0000 0000 0000", "00 000 000 000", "0 00 00 00 000 000 00", "A0000A000", "A00000000", "AAAAAA00A00A000A", "00000000000"))

    def place(self) -> str:
        return self.word(1, 2).title() + self.one("", "", "ton", "ville", "burg", "ford", "mouth", "stad", "heim", "wick", "by", " Bay", " Falls", " Springs", "field", "port", "gate")

    def street(self) -> str:
        n = str(self.r.randint(1, 400)) + self.one("", "", "", "", "a", "b", "c")
        name = self.one(self.word(1, 3).title() + self.one("", "", "ly", "field", "wood", "well", "low"), self.one("Elm", "Oak", "Mill", "Church", "King", "Station", "Park", "Garden", "School", "Lake", "River", "Hill"))
        west = f"{n} {name} {self.one('Road', 'Street', 'Lane', 'Avenue', 'Ave', 'Way', 'Close', 'Drive', 'Court', 'Place', 'Square', 'Rd', 'St', 'Terrace', 'Hill', 'Crescent', 'Row')}"
        other = self.one(f"{name}{self.one('straße', 'strasse', 'weg', 'gasse', 'allee', 'platz', 'gatan', 'veien', 'straat', 'laan')} {n}", f"{self.one('Calle', 'Via', 'Rua', 'Avenida', 'Plaza', 'ulica')} {name} {n}", f"{n} {self.one('rue', 'avenue', 'boulevard', 'chemin')} {self.one('de', 'du', 'des', 'de la')} {name}")
        inner = self.one(f"{self.one('Flat', 'Apartment', 'Unit', 'Suite', 'Room')} {self.r.randint(1, 60)}, {west}", f"{west}, {self.one('Apt', 'Apartment', 'Flat', 'Floor')} {self.r.randint(1, 60)}", f"{west} {self.one('Apt', 'Apt.', '#')} {self.r.randint(1, 60)}")
        return self.r.choices([west, other, inner], [5, 4, 3])[0]

    def address(self) -> str:
        return self.street() + self.one("", "", f", {self.place()}", f", {self.place()} {self.digits(5)}", f", {self.digits(5)} {self.place()}", f", {self.place()} {self.fill('AA0 0AA')}", f", {self.digits(4)} {self.place()}")

    def family(self) -> str:
        plain = self.word(1, 3).title() + self.one("", "", "", "n", "r", "s", "son", "sen", "ski", "ova", "ini", "ez", "mann", "berg", "sky", "ström", "dottir", "ley", "ton", "ert", "oglu", "ian", "enko")
        stem = self.one(*"Br Cl Dr Fl Gr H K L M N P R S St T Tr V W Wh".split()) + self.one(*"a e i o u ai ee oo".split()) + self.one(*"ck ld ll m n nd ng r rn rt sk st tch ver w".split())
        plain = self.one(plain, self.one(*FAMILY), stem + self.one(*"well wood worth wick field combe land more ridge croft ham ers ings el in o a i y".split()))
        return self.one(plain, plain, plain, plain, f"{self.one('van', 'de', 'von', 'di', 'El', 'da')} {plain}", f"{self.one('Mc', 'O’', chr(79) + chr(39), 'Mac')}{plain}", f"{plain}-{self.word(1, 2).title()}")

    def person(self) -> str:
        first, last = self.r.choice(GIVEN), self.family()
        if self.r.random() < 0.12:  # a name that no list has comes with a family name
            return f"{self.word(1, 3).title()} {last}"
        return self.one(f"{first} {last}", f"{first} {last}", f"{first} {last}", f"{first} {last}", first, first, f"{first} {self.r.choice('ABCDEFGHJKLMPRST')}. {last}", f"{first[0]}. {last}", f"{last}, {first}", f"{first} {self.r.choice(GIVEN)} {last}")

    def number(self, n: int) -> str:
        return self.digits(n)

    def plain(self, name: str) -> str:
        """What a place that isn't personal is filled with."""
        if name.startswith("number"):
            return self.digits(int(name[6:]))
        if name in ("version", "time", "date"):
            forms = {"version": ("0.0", "0.00.0", "00.0", "0.0.0.00"), "time": ("00:00", "0:00", "00.00"), "date": ("0000-00-00", "00.00.0000", "0/00/0000", "00/00/00")}
            return self.fill(self.one(*forms[name]))
        return {"letters": lambda: self.fill(self.one("AA", "AAA", "A")), "capital": lambda: self.fill("A"), "homograph": lambda: self.one(*HOMOGRAPHS), "place": lambda: self.one(*PLACES), "Common": lambda: self.one(*COMMONS), "thing": lambda: self.thing(), "code": lambda: self.word(1, 2) + self.digits(self.r.randint(3, 6)), "Name": lambda: self.word(2, 5).title()}[name]()

    def thing(self) -> str:
        thing = self.one(*THINGS)
        return thing.title() if self.r.random() < 0.4 else thing

    def filled(self, row: str) -> list[tuple[str, str | None]]:
        """The parts of a row: text, and the kind of what is personal."""
        parts: list[tuple[str, str | None]] = []
        for k, x in enumerate(row.replace("}", "{").split("{")):
            parts.append((x, None) if k % 2 == 0 else (getattr(self, x)(), x) if x in KINDS else (self.plain(x), None))
        return parts

    def filler(self) -> str:
        words = [self.one(*FILLER) if self.r.random() < 0.7 else self.word(2, 5) for _ in range(self.r.randint(1, 12))]
        if self.r.random() < 0.45:
            words[self.r.randrange(len(words))] = self.word(3, 5).title()
        if self.r.random() < 0.15:
            words[self.r.randrange(len(words))] = self.word(1, 1) + self.digits(self.r.randint(3, 6))
        if self.r.random() < 0.1:
            words[self.r.randrange(len(words))] = str(self.r.randint(2, 900))
        return " ".join(words) + self.one("", "", "", "?", ".", "!")

    def question(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text and its pieces of personal data (start, end, kind)."""
        r = self.r
        rows = [self.filled(r.choice(ROWS)) for _ in range(r.choice([0, 1, 1, 1, 2, 2]))] + [self.filled(r.choice(PLAIN)) for _ in range(r.choice([0, 0, 1]))]
        if r.random() < 0.15:  # a piece without any row around it
            kind = r.choice(KINDS)
            rows.append([(getattr(self, kind)(), kind)])
        r.shuffle(rows)
        if r.random() < 0.75 or not rows:
            rows.insert(r.choice([0, len(rows)]), [(self.filler(), None)])
        text, pieces = "", []
        for k, row in enumerate(rows):
            text += r.choice([" - ", " | ", ". ", ", ", "; ", " and ", "\n", " ", " ", "? ", " (", ": "]) if k else ""
            case = r.random()
            change = str.upper if case < 0.08 else str.lower if case < 0.22 else (lambda s: s)
            first = case > 0.6
            for j, (part, kind) in enumerate(row):
                if j == 0 and first and kind is None and part:
                    part = part[0].lower() + part[1:]
                part = change(part)
                if kind:
                    pieces.append((len(text), len(text) + len(part), kind))
                text += part
        return text, pieces


def examples(n: int, seed: int = 1) -> list[tuple[str, list[tuple[int, int, str]]]]:
    writer = _Writer(seed)
    return [writer.question() for _ in range(n)]


def tagged(text: str, pieces: list[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    """Words and label numbers. A word belongs to the piece in which it starts."""
    words, tags, before = [], [], None
    for start, word in words_of(text):
        piece = next((p for p in pieces if p[0] <= start < p[1]), None)
        tags.append(LABELS.index(("I-" if piece == before else "B-") + piece[2]) if piece else 0)
        words.append(word)
        before = piece
    return words, tags
