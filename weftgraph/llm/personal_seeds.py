"""A labelled sample for the detector of personal information, written from general knowledge.

Frames are sentences, fields and table cells of mail, contracts, tickets and notes in five
languages; a rule fills their slots with made-up values of many shapes.  No frame comes from
the corpus, which a test checks.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

# Common given names of many countries.  A feature only: no name needs to be listed.
GIVEN_NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Emily Mark "
    "Hannah Paul Laura Andrew Rachel Peter Anna Hans Claudia Jürgen Monika Stefan Petra Wolfgang Sabine Uwe Ute Lukas Lena Felix Sophie Jean Marie Pierre Camille Louis Chloé Nicolas Élodie "
    "François Isabelle Antoine Manon José Carmen Antonio María Manuel Lucía Javier Ana Carlos Elena Miguel Rosa Pedro Beatriz João Giovanni Giulia Marco Francesca Luca Chiara Paolo Jan Piotr "
    "Agnieszka Tomasz Katarzyna Pavel Jana Ivan Olga Dmitri Natalia Sergei Svetlana Bogdan Andrei Ioana László Zsófia Nikos Eleni Lars Ingrid Erik Astrid Bjørn Freja Mikko Aino Mohammed Fatima "
    "Ahmed Aisha Ali Leila Omar Yasmin Hassan Zeynep Mehmet Ayşe Ravi Priya Arjun Ananya Sanjay Deepa Wei Li Ming Xiu Hiroshi Yuki Kenji Sakura Minh Linh Kwame Ama Chinedu Ngozi Thabo Lerato"
).split()
_SURNAMES = (
    "Smith Jones Brown Taylor Wilson Evans Walker Wright Robinson Thompson Hughes Edwards Clarke Turner Hill Cooper Morris Ward Murphy Kelly O'Brien McCarthy MacLeod Fitzgerald Müller Schmidt "
    "Schneider Fischer Weber Wagner Becker Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Braun Martin Bernard Dubois Durand Leroy Moreau Lefebvre Garnier Rousseau García Fernández López "
    "Martínez Sánchez Pérez Gómez Ruiz Navarro Torres Silva Santos Rossi Ferrari Esposito Colombo Novák Kowalski Wiśniewski Nowak Horvat Popescu Ivanov Petrov Papadopoulos Hansen Nielsen Andersson "
    "Virtanen Khan Hussein Yılmaz Demir Patel Sharma Singh Nguyen Tran Wang Zhang Chen Tanaka Suzuki Mensah Okafor Dlamini"
).split()
#: Common endings of family names.
SURNAME_ENDINGS = "mann son sen sohn ski ska sky cki ová ova ov ev in ez es ini etti elli oglu oğlu yan ian enko vich vić ić wick ton ham ley ford field feld stein berg burg bach quist ström strom lund gren dóttir dottir escu opoulos idis eira ard eau oux moto mura".split()
PARTICLES = ("von der", "van der", "van den", "de la", "von", "van", "de", "del", "della", "di", "da", "dos", "al", "el", "bin", "ten")
ROADS = {
    "after": ["Street", "Lane", "Avenue", "Close", "Rd", "Road", "blvd", "Boulevard", "Drive", "Court", "Crescent", "Terrace", "Way", "Square", "Ave", "St"],
    "before_fr": ["rue", "avenue", "place", "boulevard", "allée", "impasse", "chemin", "quai"],
    "before_number": ["Calle", "Avenida", "Plaza", "Paseo", "Via", "Rua"],
    "joined": ["straße", "strasse", "gasse", "platz", "weg", "allee"],
    "apart": ["Weg", "Platz", "Allee", "Ring", "Straße", "Gasse"],
}
PLACE_WORDS = {w.lower().rstrip(".") for words in ROADS.values() for w in words}
#: Short words that stand in front of names or begin sentences and are no part of one.
FUNCTION_WORDS = set(
    "a an the this that these those some any each every no all both either neither my your his her its our their i you he she it we they and or but nor so yet if when while as since because "
    "until after before of to in on at by for from with without about into over under between via per not is are was were has had do does did then now here there today yesterday tomorrow "
    "der die das den dem des ein eine einer eines und oder aber wenn weil als wie wir ihr sie er es ich von zu im in am an auf bei mit ohne nach vor seit für laut heute gestern morgen nicht "
    "le la les l un une des du de d et ou mais si quand comme nous vous il elle ils elles je à au aux en dans par pour sur avec sans selon avant après depuis hier aujourd'hui demain "
    "el los las un una unos unas y o pero si cuando como nosotros ellos ella yo en por para con sin según antes después desde hoy ayer mañana del al".split()
)
TITLES = "mr mrs ms miss dr prof sir herr frau hr fr dipl mme mlle madame monsieur sr sra srta señor señora don doña signor signora".split()
#: Labels of fields that hold a person.
PERSON_LABELS = "name owner author assignee reviewer approver contact editor sender recipient customer patient employee manager speaker host witness kunde bearbeiter autor prüfer verfasser auteur client responsable cliente revisor firmante 氏名 担当 担当者 著者".split()
#: After these, names in small letters are looked for.
LOWER_CUES = [*TITLES, *PERSON_LABELS, "by", "to", "from", "thanks", "von", "par", "por", "laut", "selon", "según", "and", "but", "both", "with", "owe", "of"]

#: Words near a span, by kind; single words of general vocabulary in five languages.
CUES = {
    "phone": r"(?<![A-Za-z])(?:tel|phones?|telephone|mobile|cell|fax|call|calling|answer\w*|my number|ring|rings|rung|rang|dial|text|sms|whatsapp|voicemail|pager|hotline|reach|reached|extension|telefon\w*|handy|rufnummer|durchwahl|anruf\w*|erreich\w*|téléphone\w*|portable|appel\w*|joindre|joignable|teléfono|móvil|llam\w*)(?![A-Za-z])|電話|携帯",
    "identity": r"(?<![A-Za-z])(?:ssn|social|passport\w*|national|identity|identi[td]\w*|insurance|id|tax\w*|taxpayer|licen[cs]e\w*|citizen|person|applicant|card|holder|inhaber\w*|titular\w*|document\w*|ausweis\w*|pass\w*|steuer\w*|versicherung\w*|carte|passeport|fiscal|sécu\w*|dni|nif|nie|cédula|pasaporte|documento)(?![A-Za-z])|番号|旅券",
    "address": r"(?<![A-Za-z])(?:address\w*|lives?|living|resid\w*|moved?|office|deliver\w*|ship\w*|sent|send|mail|post|visit|located|house|home|anschrift|adresse\w*|wohn\w*|liefer\w*|gesendet|domicil\w*|habite\w*|livr\w*|envoy\w*|colis|direcci\w*|domicilio|vive|enví\w*|paquete)(?![A-Za-z])|住所",
    "number": r"(?<![A-Za-z])(?:numbers?|no|nr|nummer|numéro|número|n°|nº)(?![A-Za-z])",
    "technical": r"(?<![A-Za-z])(?:versions?|builds?|release|firmware|schema|checksum|hash|commit|offsets?|bytes?|rows?|port|ports|invoice|order|batch|ticket|issue|part|serial|model|sku|isbn|doi|code|bin|shelf|error|status|timeout|ms|seconds|range|page|pages|lines|key|keys|pin|figures?|table|section|item|font|theme|tag|count|amount|total|euros?|usd|eur)(?![A-Za-z])",
}

NAME_FRAMES = """
Minutes were taken by <N>.
<N> chaired the call and <N> took notes.
Please forward this to <N> before Monday.
The fix came from <N>, who also wrote some tests.
<N> disagrees with that proposal.
<N> asked whether it could wait.
<N> noticed a gap in the numbers.
Last week <N> rewrote the parser from scratch.
Today <N> called in sick.
In spring <N> will move to Lyon.
At noon <N> stopped the server and went home.
Earlier <N> had shown how it works.
Then <N> repeated the experiment with success.
I met <N> at a conference.
Approved by: <N>
Prepared by <N>
Reviewer: <N>
owner: <N>
author = <N>
"author": "<N>",
"created_by": "<N>"
"assignee" : "<N>"
approver | <N> | yes
| manager | <N> | pending |
| <N> | engineer | Berlin |
* <N> will prepare the slides
- [x] <N>: book a room
- [ ] <N> to confirm the budget
TODO (<N>): rename this
1. <N>
<N>: I think shipping is fine.
<N>: No, not this month.
<N>:\tagreed
> <N> wrote:
Dear Mr. <N>,
Dear <N>,
Best regards,\n<N>
Sincerely yours,\n<N>\nHead of Support
Dr. <N> examined the sample.
Prof. <N> and Mrs. <N> agreed on a date.
Ms <N> rang twice.
Mr <N> signed the contract; Mrs <N> did not.
A letter from Mrs. <N>.
Interview with <N>
CC <N> on all replies, please.
The keys were handed over to <N> last week.
In the words of <N>, it simply works.
As <N> put it, nothing broke.
Only <N> can open the safe.
No one except <N> was informed.
Credit goes to <N> here.
With help from <N> it was finished early.
Many thanks to <N> and <N>.
Neither <N> nor the board replied.
The suggestion was made by <N> over dinner.
The case of <N> was reopened in June.
The file of <N> is incomplete.
Participants: <N>, <N> and the whole sales team
Present: a guest, <N>
My colleagues still owe <N> a reply.
Kunde: <N>
Sachbearbeiter: <N>
Geprüft durch <N>
Freigegeben von <N>
Herr <N> ruft morgen zurück.
Frau <N> ist im Urlaub.
Heute hat <N> angerufen.
Am Montag war <N> nicht da.
<N> übernimmt den Termin.
Mit freundlichen Grüßen\n<N>
Die Idee stammt von <N>.
Nach Ansicht von <N> reicht das.
Das Protokoll führte <N>.
Monsieur <N> a signé le contrat.
Mme <N> rappellera demain.
D'après <N>, tout va bien.
Vu par <N>
<N> a proposé une autre date.
Ce matin <N> a redémarré le serveur.
Cordialement,\n<N>
Merci à <N> pour son aide.
Aprobado por <N>
Firmado por <N>
El señor <N> llegó tarde.
Hoy <N> llamó al cliente.
Anoche <N> volvió a casa.
Como dijo <N>, esto basta.
Atentamente,\n<N>
担当者：<N>
著者は <N> でした。
<N> さんが発表しました。
責任者は<N>です。
"""

UNLIKE_FRAMES = """
<sys> was restarted at noon.
| <sys2> | ready | 0.42 |
| <sys2> | <sys2> | parent |
| <up> | <sys2> | 3 |
| <sys2> | <word> | yes |
| Host | <sys2> |
The patch is due to <sys> and nothing else.
The fix came from <team>, who also wrote some tests.
owner: <team>
author = <team>
"assignee" : "<team>"
| manager | <team> | pending |
Approved by <team>.
Reviewer: <sys>
Only <sys> can open the file.
No one except <team> was informed.
Today <sys> crashed twice.
In spring <sys> will be replaced.
With help from <sys> it was finished early.
In the words of <team>, it simply works.
Many thanks to <common>.
Prepared by <common>
- [ ] <common>
TODO (<common>): rename this
Unlike <sys>, this one is free.
<sys> reads from <sys> and <sys>.
<product> is a product name; so is <product>.
The <product> demo failed again.
<product> and <product> run on the same host.
# <Title>
## <Title> for <sys>
### <sys>
<Title>:
**<Title>**
| <Title> | <Title> |
See <Title> on page 4.
Flights to New Zealand and the United Kingdom were full.
The font is Times Roman, the color Midnight Blue.
Monday Morning and Friday Evening are slots.
<TITLE>
NOTE: <TITLE> IS <TITLE>
<TITLE> OF <TITLE>
The <up> <title> theme is new.
Das System <sys> läuft.
Der Server <up> steht im Keller.
Die Firma <up> zahlt nicht, das Werk <up> schon.
Kleinere Fehler wurden behoben.
Weitere Hinweise stehen im Anhang.
Neue Anträge kamen nicht an.
Mehrere Abschnitte fehlen noch.
Wichtige Termine stehen rot im Kalender.
- Frühere Ausgaben waren dicker.
Die Übersicht von <sys> fehlt.
Heute war <sys> nicht da.
Freigegeben von <team>
Laufzeit Tabelle Spalte Zeile
Für Anfänger gibt Kapitel Drei eine Übersicht.
Der Bericht nennt Größe Gewicht und Alter.
Nach Angaben der Prüfer fehlen Belege.
Le service <sys> est lent.
Vu par <team>
L'outil <sys> a redémarré le serveur.
El sistema <sys> es lento.
Como dijo <team>, esto basta.
Firmado por <team>
<sys> が停止しました。
担当者：<team>
by <low>, then by <low>
The harbour froze early that winter, and fishermen repaired torn nets beside crackling stoves.
Grandmother kept dried herbs, smoked ham and pickled plums in a draughty pantry.
Hikers crossing mossy plateaus often underestimate sudden fog and icy gusts.
A clockmaker polished brass gears while sparrows quarrelled under leaky gutters.
Im Herbst sammelten die Nachbarn Pilze, kochten Suppe und erzählten einander alte Geschichten.
Der Bäcker knetet morgens Teig, während draußen Laternen flackern und Zeitungen verteilt werden.
Wanderer unterschätzen häufig plötzlichen Nebel, glatte Wege und eisige Böen.
Die Brücke wurde gesperrt, nachdem Risse entdeckt und mehrere Träger ausgetauscht werden mussten.
Viele Gäste blieben trotzdem gelassen, weil Musikanten fröhliche Lieder spielten.
En automne, les voisins ramassaient des champignons et racontaient de vieilles histoires.
Le boulanger pétrit sa pâte tandis que les lanternes vacillent dans la ruelle déserte.
Les randonneurs sous-estiment souvent le brouillard soudain et les rafales glaciales.
Chaque tonneau vide est rincé puis rangé derrière une grange dont le toit fuit.
En otoño los vecinos recogían setas, cocinaban sopa y contaban viejas historias.
El panadero amasa temprano mientras las farolas parpadean sobre calles desiertas.
Muchos excursionistas subestiman la niebla repentina y las ráfagas heladas cuyo origen ignoran.
Las tormentas derribaron tejados, inundaron bodegas y dejaron caminos cubiertos de barro.
El molino viejo cuya rueda chirría pertenece a un primo lejano.
from <low> to <low>
Thanks to <low>, it is faster.
we owe <low> to both <low> and <low>
von <low> bis <low>
par <low> et par <low>
"""

VALUE_FRAMES = """
Please mail <E> with any doubts.
Email: <E>
E-Mail: <E>
From: <E>
To: <E>; <E>
"email": "<E>",
email=<E>
<E> is the new mailbox.
(<E>)
[<E>](mailto:<E>)
<<E>>
| <E> | admin |
Sent by <E> on Tuesday.
Reset the password of <E> today.
Schreiben Sie an <E>.
Envoyez un mot à <E>.
Mándelo a <E> cuanto antes.
メールは <E> です。
author <E> 2019
user <E> logged in from a new device
Phone: <P>
Tel. <P>
phone=<P>
"mobile": "<P>",
| hotline | <P> |
Fax <P>
You can ring me on <P> until noon.
Dial <P> and press two.
Text <P> if you are late.
Just call <P>.
For bookings, call <P> any day.
My cell is <P>, by the way.
The doctor's number is <P> these days.
She can be reached under <P> at night.
The message was left on <P> last night.
Handy: <P>
Sie erreichen mich unter <P>.
Rufen Sie <P> an.
Appelez le <P> après midi.
Téléphone : <P>
Llame al <P> por la tarde.
Mi número es el <P>.
携帯は <P> です。
+ call back <P>
WhatsApp <P>
My number is <P> until May.
My number: <P>
No answer? Then use <P> instead.
Please ring the night porter of our second building on <P>
He wants a call back before lunch, at <P>.
The pager <P> is silent.
Phone for the evening shift: <P>
Dial this for the weekly meeting: <P>.
Telephone conference of the board, code follows: <P>
She left her mobile (<P>) at the desk.
Ihr Anruf wird weitergeleitet an <P>.
Um Rückruf unter <P> wird gebeten.
On peut vous joindre au <P> ?
En cas d'urgence, téléphone <P>.
Para emergencias llame al <P>.
Su móvil <P> no responde.
お電話は <P> まで
SSN: <I>
Passport number <I>
national_id=<I>
"identity": "<I>",
| taxpayer | <I> |
id card <I>
His passport <I> expires soon.
The form gave <I> as social security number.
Tax number <I> belongs to a private person.
She wrote <I> into the identity field.
Driving licence <I> was suspended.
Insurance number: <I>
Applicant <I> failed the identity check.
Steuernummer <I>
Sein Ausweis trägt die Nummer <I>.
Carte d'identité n° <I>
Mon numéro fiscal est <I>.
DNI <I>
El pasaporte <I> ha caducado.
旅券番号 <I>
The scanned copy shows passport <I> in full.
Her social security number is <I>.
The applicant with national identity number <I> moved abroad.
A copy of the licence (<I>) is attached.
The insured person has the number <I>.
identity_no	<I>
id_card: <I>
tax_id = <I>
Taxpayer <I> filed twice.
The row has a person's tax number, <I>, in plain text.
Die Inhaberin des Passes <I> ist bekannt.
Versicherungsnummer der Mutter: <I>
Personalausweis Nr. <I> liegt vor.
Le passeport <I> est périmé.
Le titulaire de la carte <I> a signé.
Número de identidad: <I>
El titular del documento <I> firmó ayer.
| applicant | <I> | checked |
"person": "<I>"
Address: <A>
Residence: <A>
address = <A>
"street": "<A>",
| home | <A> |
They live at <A>.
We are located at <A>.
He now resides at <A>
Deliver the parcel to <A>.
Visit us at <A> next week.
Mail it to <A>, please.
Our new office is <A>.
The fire at <A> was put out.
Anschrift: <A>
Sie wohnt seit Mai in der Nähe: <A>
Bitte liefern Sie an <A>.
Adresse : <A>
J'habite au <A>.
Livrez-le au <A>.
Vive en <A>.
Dirección: <A>
住所：<A>
<N>\n<A>\n<P>
<N>\n<A>\n<E>
<N>\n<A>
<N>\n<A>\n\n
Absender\n<N>\n<A>
<N>\n<A>\n<P> | <E>
To\n<N>\n<A>
<N>\n<A>
\n<N>\n<A>
<A>\n<P>
<A>\n<P> | <E>
\n<N>\n<A>\n<P>
Someone put <I> in the passport box.
<I> is her tax number.
He copied <I> from the identity card.
They stored <I> in the licence column.
<I> (passport)
<P> (mobile)
<P> is the number of our hotline.
Nous avons noté <P> comme téléphone.
<title>\n<A>
<N>\n<P>
"""

TECH_FRAMES = """
git@code.host:<word>/<word>.git
npm install <word>@<ver>
@<word>.<word>
ssh <word>@<word>
user@host is a placeholder
Version <num> replaces <num>.
Build <num> passed.
Order <num> was shipped, order <num> was not.
Part <num> is out of stock.
Serial no. <num>
checksum <num>
Bytes <num> to <num> are free.
ISBN <num>
Rows <num> and <num> differ.
Invoice <num> is paid.
error code <num>
timeout after <num> ms
Ticket <num> duplicates <num>.
Model <num> and model <num>
| item | <num> |
"build": "<num>",
count=<num>
Batch <num> of bin <num>
10.4.0.17:8080 answered
2024-03-01 12:30:45 started
The table has <num> rows, the other <num>.
Figure 12, Baker Street style, has 4 colors.
The Main Street font and the Oak Lane font differ.
Gate <num> and key <num>
<road> is a song.
They played <road> twice.
The board game has <road> and <road>.
Four colors are used; <road> is a brand.
<road> was a film, not a place.
Put @<word>.<word> above the method.
an @<word> handle with @<word>
between <num> and <num> there is a gap
firmware <num>
"""

FILLERS = ("It works.", "Nothing else changed.", "the old file was kept", "Costs went down.", "Das reicht.", "On verra.", "Nada más.", "See above.")
_SLOT = re.compile(r"(<(?:[EPIAN]|num|sys2?|team|up|product|common|low|word|ver|title|Title|TITLE|road)>)")
KINDS = {"E": "email", "P": "phone", "I": "identity_number", "A": "street_address", "N": "person_name"}
_ONSETS = "b c d f g h j k l m n p r s t v w y z br ch dr fl gr kr pl sh sl st th tr".split()
_NUCLEI, _CODAS = "a e i o u a e i o ai ea ou".split(), ["", "", "", "n", "r", "l", "s", "m", "t", "k", "nd", "x"]


def frames() -> list[str]:
    """All frames; those of names a second time with what is no name in their slots."""
    twins = [re.sub("<N>", f"<{('sys2', 'sys2', 'product', 'team')[k % 4]}>", f) for k, f in enumerate(NAME_FRAMES.strip().split("\n"))]
    return [f.replace("\\n", "\n").replace("\\t", "\t") for block in (NAME_FRAMES, VALUE_FRAMES, TECH_FRAMES, UNLIKE_FRAMES) for f in block.strip().split("\n")] + [f.replace("\\n", "\n").replace("\\t", "\t") for f in twins]


def labelled_sample(words: Sequence[str], rounds: int = 30, seed: int = 7, part: int | None = None) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Texts with their marked spans ``(kind, start, end)``: every frame ``rounds`` times, filled anew.

    ``words`` are everyday words of a public vocabulary, for titles and names of teams and
    products.  ``part`` takes only every other frame, the odd or the even ones.
    """
    r = random.Random(seed)
    make = _Maker(r, words)
    chosen = [f for k, f in enumerate(frames()) if part is None or k % 2 == part]
    out = []
    for _ in range(rounds):
        r.shuffle(chosen)
        for k in range(0, len(chosen), 3):
            text, marks = "", set()
            for frame in chosen[k : k + 3]:
                if r.random() < 0.3:
                    text += r.choice(FILLERS) + r.choice([" ", "\n", "\n\n"])
                if r.random() < 0.3:  # more words between a label and its value
                    frame = re.sub(r"^(\w+)(\s?[:=] <[PIA]>)", lambda m: f"{m[1]} {r.choice(['of the', 'for the', 'in this'])} {make('<common>')}{m[2]}", frame)
                for piece in _SLOT.split(frame):
                    value = make(piece) if _SLOT.fullmatch(piece) else piece
                    if piece[1:-1] in KINDS and value != piece:
                        marks.add((KINDS[piece[1:-1]], len(text), len(text) + len(value)))
                    text += value
                text += r.choice([" ", "\n", "\n\n"]) if text.endswith((".", "。")) and "\n" not in frame else "\n\n"
            out.append((text, marks))
    return out


class _Maker:
    """Made-up values for the slots of frames."""

    def __init__(self, r: random.Random, words: Sequence[str]):
        self.r, self.words = r, [w for w in words if len(w) > 3]

    def word(self, most: int = 3) -> str:
        r = self.r
        return "".join(r.choice(_ONSETS) + r.choice(_NUCLEI) for _ in range(r.randint(1, max(1, most - 1)))) + r.choice(_ONSETS) + r.choice(_NUCLEI) + r.choice(_CODAS)

    def digits(self, *sizes: int) -> list[str]:
        return ["".join(self.r.choice("0123456789") for _ in range(n)) for n in sizes]

    def split(self, total: int, least: int = 2, most: int = 4) -> list[int]:
        sizes = []
        while total > most + least - 1 or total > most:
            n = self.r.randint(least, min(most, total - least))
            sizes.append(n)
            total -= n
        return [*sizes, total]

    def __call__(self, slot: str) -> str:
        return getattr(self, "_" + {"E": "email", "P": "phone", "I": "identity", "A": "address", "N": "name", "Title": "title1", "TITLE": "title2"}.get(slot[1:-1], slot[1:-1]))()

    def surname(self) -> str:
        r = self.r
        kind = r.random()
        if kind > 0.96:
            return r.choice(self.words).capitalize()
        return r.choice(_SURNAMES) if kind < 0.35 else self.word(2).capitalize() + r.choice(SURNAME_ENDINGS) if kind < 0.7 else self.word(4).capitalize()

    def _name(self) -> str:
        r = self.r
        given, sur, form = (r.choice(GIVEN_NAMES) if r.random() < 0.5 else self.word(3).capitalize()), self.surname(), r.random()
        if form < 0.08:
            return f"{sur}, {given}"
        if form < 0.15:
            return f"{sur.upper()} {given}"
        if form < 0.22:
            return f"{given} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {sur}"
        if form < 0.30:
            return f"{given} {r.choice(PARTICLES)} {sur}"
        if form < 0.38:
            return f"{r.choice('ABCDEFGHIJKLMNOPRSTUVWYZ')}. {sur}"
        if form < 0.45:
            return f"{given} {sur}".lower()
        if form < 0.53:
            return f"{given} {sur}-{self.surname()}"
        if form < 0.58:
            return f"{given} {self.word(3).capitalize()} {sur}"
        return f"{given} {sur}"

    def _email(self) -> str:
        r = self.r
        given, sur = self._name_part(), self.word(3)
        local = r.choice([given, f"{given}.{sur}", f"{given}_{sur}", f"{given}{sur}", f"{given[0]}{sur}", f"{sur}{r.randint(1, 99)}", f"{given}.{sur[0]}+{self.word(2)}", f"{given}-{sur}", "info", "office"])
        domain = r.choice(["", "", "mail.", "post."]) + self.word(4) + r.choice(["", "", f"-{self.word(2)}"]) + r.choice([".com", ".org", ".net", ".de", ".fr", ".es", ".co.uk", ".io", ".edu", ".example", ".test", ".invalid", ".example.com", ".example.org"])
        form = r.random()
        whole = f"{local}@{domain}" if form < 0.7 else f"{local}(at){domain}" if form < 0.77 else f"{local}[at]{domain}" if form < 0.8 else f"{local} @ {domain}" if form < 0.9 else f"{local} [at] {domain.replace('.', ' [dot] ')}"
        return whole.upper() if form < 0.07 else whole

    def _name_part(self) -> str:
        given = self.r.choice(GIVEN_NAMES).lower()
        return given if given.isascii() else self.word(3)

    def _phone(self) -> str:
        r = self.r
        gap = r.choice([" ", " ", "-", ".", " ", ""])
        form = r.random()
        if form < 0.3:
            return f"+{r.choice([1, 7, 30, 31, 33, 34, 39, 44, 46, 48, 49, 61, 81, 353, 351])}{gap}" + gap.join(self.digits(*self.split(r.randint(8, 10))))
        if form < 0.36:
            return f"+{r.choice([33, 39, 44, 49, 61])} (0){gap if gap != '' else ' '}" + (gap or " ").join(self.digits(*self.split(r.randint(8, 10))))
        if form < 0.44:
            return f"00{r.choice([1, 33, 34, 44, 49])} " + " ".join(self.digits(*self.split(r.randint(8, 10))))
        if form < 0.56:
            a, b, c = self.digits(3, 3, 4)
            return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"{a} {b} {c}"])
        if form < 0.66:
            return "0" + self.digits(1)[0] + "".join((gap or " ") + d for d in self.digits(2, 2, 2, 2))
        if form < 0.78:
            area, rest = self.digits(r.randint(1, 4))[0], self.digits(*self.split(r.randint(5, 8)))
            return r.choice([f"0{area}/{'-'.join(rest)}", f"(0{area}) {' '.join(rest)}", f"0{area} {' '.join(rest)}", f"0{area} {''.join(rest)}", f"0{area}-{''.join(rest)}"])
        return "0" + self.digits(r.randint(2, 4))[0] + " " + " ".join(self.digits(*self.split(r.randint(6, 8))))

    def _identity(self) -> str:
        r = self.r
        letter = lambda: r.choice("ABCDEFGHJKLMNPRSTXYZ")
        d = self.digits
        form = r.randint(0, 9)
        return [
            lambda: "-".join(d(3, 2, 4)), lambda: " ".join(d(3, 2, 4)), lambda: f"{letter()}{letter()} {' '.join(d(2, 2, 2))} {letter()}", lambda: f"{letter()}{letter()}{d(6)[0]}{letter()}", lambda: d(8)[0] + r.choice(["", "-"]) + letter(),
            lambda: f"{letter()} {' '.join(d(3, 3))} {d(1)[0]}", lambda: letter() + r.choice(["", letter()]) + d(7)[0], lambda: " ".join(d(2, 3, 3, 3)), lambda: letter() + d(8)[0], lambda: "".join(d(9)),
        ][form]()

    def _address(self) -> str:
        r = self.r
        n, street, town, code = r.randint(1, 480), self.word(3).capitalize(), self.word(2).capitalize() + r.choice(["ford", "ton", "ville", "stadt", "heim", "bury", "", ""]), self.digits(5)[0]
        after, french, spanish = r.choice(ROADS["after"]), r.choice(ROADS["before_fr"]), r.choice(ROADS["before_number"])
        return [
            lambda: f"{n} {street} {after}, {town}", lambda: f"{n} {street} {after}, {town} {code}", lambda: f"{n} {street} {after}", lambda: f"{n} {street} {after}, {r.choice(['Apt', 'Suite', 'Unit'])} {r.randint(1, 99)}{r.choice(['', 'A', 'C'])}, {town} {code}",
            lambda: f"Flat {r.randint(1, 60)}, {n} {street} {after}, {town}", lambda: f"{n} {street} {after}, {town} {r.choice('BEGLMSW')}{r.choice(['', 'N', 'E'])}{r.randint(1, 29)} {r.randint(1, 9)}{r.choice(['AB', 'DH', 'QT', 'XZ'])}",
            lambda: f"{n} {street.lower()} {after.lower()}, {town.lower()}", lambda: f"{n} {r.choice(['Old', 'North', 'Upper'])} {street} {after}., {town}, {code}",
            lambda: f"{n}{r.choice(['', ' bis', ' ter'])}{r.choice(['', ','])} {french} {r.choice(['', 'de ', 'de la ', 'du '])}{street}, {code} {town}", lambda: f"{n} {french} {street}",
            lambda: f"{spanish} {street} {n}, {code} {town}", lambda: f"{spanish} {street} {n}, {r.randint(1, 9)}º {r.choice('ABCD')}, {code} {town}",
            lambda: f"{street}{r.choice(ROADS['joined'])} {n}{r.choice(['', 'a', 'b'])}, {code} {town}", lambda: f"{street}{r.choice(ROADS['joined'])} {n}", lambda: f"{street}er {r.choice(ROADS['apart'])} {n}{r.choice(['', 'a'])}, {code} {town}",
        ][r.randint(0, 14)]()

    def _num(self) -> str:
        r, d = self.r, self.digits
        return [
            lambda: ".".join(d(2, 2, 2, 2, 2)), lambda: ".".join(d(1, 2, 3)), lambda: d(r.randint(5, 12))[0], lambda: "-".join(d(3, 3, 4)), lambda: "-".join(d(3, 2, 3)), lambda: " ".join(d(3, 3, 3)), lambda: " ".join(d(1, 3, 3)), lambda: "-".join(d(3, 3, 3)),
            lambda: f"{self.word(2)[:2].upper()}{d(7)[0]}", lambda: f"{self.word(2)[:2].upper()}-{'-'.join(d(3, 3))}", lambda: "-".join(d(3, 2, 4)), lambda: " ".join(d(3, 2, 4)), lambda: "-".join(d(5, 3)), lambda: "-".join(d(3, 4)), lambda: "0" + "-".join(d(2, 4)), lambda: ".".join(d(4, 3, 3)),
            lambda: "-".join(d(5, 6)), lambda: " ".join(d(5, 6)), lambda: d(8)[0] + "X", lambda: "-".join(d(1, 4, 4, 1)), lambda: "/".join(d(3, 5)), lambda: "(" + d(3)[0] + ") " + d(4)[0],
        ][r.randint(0, 21)]()

    def _road(self) -> str:
        return f"{self.r.randint(1, 99)} {self.r.choice([self.word(2), *self.words]).capitalize()} {self.r.choice(ROADS['after'][:7])}"

    def _role(self) -> str:
        return self.r.choice(self.words).capitalize()

    def _sys(self) -> str:
        return self.word(4).capitalize() + self.r.choice(["", f" {self._role()}", f" {self._role()}", f" {self._role()} {self._role()}"])

    def _sys2(self) -> str:
        return f"{self.word(4).capitalize()} {self._role()}"

    def _team(self) -> str:
        return f"{self._role()} {self._role()}"

    def _up(self) -> str:
        return self.word(4).capitalize()

    def _product(self) -> str:
        return f"{self.r.choice(GIVEN_NAMES)} {self._role()}"

    def _title(self) -> str:
        return self.r.choice(self.words)

    def _title1(self) -> str:
        return " ".join(self._role() for _ in range(self.r.randint(2, 4)))

    def _title2(self) -> str:
        return " ".join(self.r.choice([*self.words[:400], self.word(4)]) for _ in range(self.r.randint(1, 3))).upper()

    def _common(self) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(2, 3)))

    def _low(self) -> str:
        r = self.r
        return " ".join(r.choice([r.choice(self.words), r.choice(self.words), self.word(3) + r.choice(["en", "t", "er", "e", "s", "ed", "ing"])]) for _ in range(2))

    def _word(self) -> str:
        return self.word(3)

    def _ver(self) -> str:
        return ".".join(str(self.r.randint(0, 20)) for _ in range(self.r.randint(2, 3)))
