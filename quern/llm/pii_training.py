"""Labelled sentences for the personal-information model, composed from parts.

Every sentence is put together from an opening, an entity written in one of
its forms and a closing, or is one of many kinds of text that only look alike.
Labels follow from the composition, so they are exact.
"""

from __future__ import annotations

import random
import string

from quern.llm.pii import STARTS, fold

#: Common given names of several languages, besides those a table lists.
GIVEN = (
    "Adam Agnès Ahmed Aisha Alan Albert Alice Amina Ana André Andrés Anna Anne Antonio Aoife Arthur Ayşe Beatriz Ben Benoît Bernd Björn Bruno "
    "Camille Carla Carlos Carmen Caroline Charles Chen Chidi Chloé Christian Clara Claude Claudia Daniel David Deniz Diego Dmitri Dörte Elena Elias Élodie Emil Emma Emre Erik Eva "
    "Fabrice Fatima Felix Florian Frank Fátima Gabriel George Georg Grace Grant Greta Hannah Hans Haruto Hassan Heike Helen Helena Henry Hiroshi Hugh Hugo Ibrahim Ines Ingrid Irina Isabel Ivan Ivy "
    "Jack Jakob James Jan Jana Javier Jean Jens Jonas Jorge José Juan Julia Jürgen Karin Karl Katja Kenji Klaus Lars Laura Leila Lena Leon Liam Lina Loïc Louise Lucas Lucía Luis Lukas Łukasz "
    "Manuel Marcel Maria Marie Mario Mark Marta Martin Mary Matthias Maya Mehmet Mei Mia Michael Miguel Mira Mohamed Nadia Natalia Ngozi Nicolas Nikolai Nils Nina Noah Noel Nora Nuria "
    "Oksana Olga Oliver Olivier Omar Oscar Owen Pablo Paul Pedro Petra Philippe Pierre Pilar Priya Rafael Raj Ramón Rémi Robert Rosa Rose Ruth Samuel Sara Sven Sofia Solène Søren Stefan Susanne "
    "Tessa Theo Thierry Thomas Tomás Tunde Ursula Ute Valerie Vera Victor Volker Walter Wei William Xavier Yuki Yusuf Yvonne Zoe Zsófia"
).split()
STEMS_A = "bar dor fen gal hol jar kel lun mar nor pel quin ral sten tor ulv var wen yor zan brek cald drun frit glim krand plov skar thal vren".split()
STEMS_B = "a e i o u an er il on ev av uth ick ell orn ast end ing".split()
ENDINGS = "wick wood well son sen ova ov ski ska quist ström holm mann berg stein feld oglu ado ez ette ard ish anby worth ley ton ford vich enko witz asz rigg krigg ello mere holt ensen strom elli ini ier eau aux ic ó".split()
FAMILIES = (
    "Nowak Kowalski Novak Horvat Popescu Ivanova Petrov Smirnov Kim Lee Park Chen Wang Li Zhang Liu Tran Nguyen Pham Tanaka Suzuki Sato Singh Patel Sharma Khan Ali Hussein Haddad Cohen Levy Silva Santos Costa Garcia Lopez Moreno Ruiz Torres Vega "
    "Rossi Russo Ferrari Conti Greco Müller Schmidt Weber Wagner Becker Koch Klein Wolf Braun Vogel Beck Lang Roth Dupont Martin Bernard Petit Moreau Girard Roux Smith Jones Brown Taylor Wilson Walker Hall Young King Wright Green Hill Baker Cook "
    "Gallagher Murphy Kelly Byrne Walsh Jansen Visser Bakker Andersen Larsen Nilsson Lindqvist Korhonen Virtanen Okafor Adeyemi Mensah Diallo Traoré Yilmaz Demir Kaya Papadopoulos"
).split()
EASTERN = "Wang Li Zhang Liu Chen Yang Huang Zhao Wu Zhou Nguyen Tran Le Pham Hoang Vu Kim Lee Park Choi Jung Tanaka Suzuki Sato Watanabe Ito".split()
SYLLABLES = "xiao ming jun wei min hao yu chen li ying mei hua anh van thanh linh minh duc huong hye jin seo ji hoon yuki haru ken mi na ra ka to shi".split()
TOWN_A = "Ash Cold Nieder Ober Larch Mont Puerto Quarrow Tann Val Villa Fenwick Bruns Harl Red Stone Alt Neu Sant Grand".split()
TOWN_B = "brook combe hollow stead ford ham münde walde rieden burg heim aubray clos morin ville court llosa nera olmedo bury field port".split()
NOUNS = (
    "account adapter agenda alias array backup balance banner bench binary bitmap border branch bridge broker bug button calendar canvas catalog chart chunk client cluster column comment compiler config console contract counter "
    "dashboard database deadline device diagram disk draft engine error event export feature field file filter folder form format function garden graph grant grid group handler header heap history hook image import index invoice issue "
    "job kernel key label lake layer layout letter library line list lock log loop machine mark meeting memory menu merge message metric migration mirror model module network note notice number object option order output page panel parser "
    "patch path payload pipeline plan plugin port printer process profile project prompt proxy query queue range record release report request response result ring river road role room rose rule runner sample schema screen script section "
    "sensor series server session setting shadow sheet shell signal socket source stack step storage stream string summary survey switch table tag target task team template test text thread ticket timer token tool tower trace train tree trigger "
    "type update upload user value vendor version view volume warning widget window worker zone"
).split()
VERBS = "add build check clean close copy count drop dump edit expand export find fix flush format group handle import join keep list load lock log merge move open pack parse print pull push read remove rename render reset retry run save scan search send skip sort split start stop store sync test trim turn update validate wait watch wrap write".split()
ADJECTIVES = "active blue broken busy common cold deep early empty fast final first flaky free full green hidden huge idle large late lazy local lost main missing narrow new noisy old open plain quick quiet random rare red remote shared short silent simple slow small stale static strange strict tiny unused upper warm weekly wrong".split()
SMALL = {
    "en": "the a of to in and it that with when while once after before no any each because then still not only where how this its for by on".split(),
    "de": "der die das ein eine und mit bei wenn weil dann noch nicht nur wo wie für von auf ist sind wird zu im am den dem".split(),
    "fr": "le la les un une et avec quand car puis encore pas seulement où comme pour par sur est sont à du des dans".split(),
    "es": "el la los un una y con cuando porque luego aún no solo donde como para por en es son a del de se".split(),
}
#: Nouns that are written with a capital.
CAPITALS_DE = "Abfrage Ablauf Adresse Änderung Anfrage Antwort Anzahl Aufgabe Ausgabe Auswahl Bereich Bericht Betrieb Datei Dienst Eingabe Einheit Ergebnis Fehler Fenster Folge Frage Gerät Grenze Gruppe Hinweis Inhalt Klasse Kopie Lauf Liste Lösung Meldung Menge Nachricht Ordner Prüfung Quelle Regel Reihe Rolle Schnittstelle Schritt Seite Sitzung Speicher Sprache Stelle Suche Tabelle Teil Umgebung Verbindung Verweis Vorgang Wert Zeile Zeit Ziel Zugriff".split()
ROLES = (
    "noreply no-reply do-not-reply donotreply bot ci ci-bot build-bot lint-bot deploy helpdesk support help sales oncall oncall-list on-call core-team all-devs everyone security postmaster webmaster root abuse releases "
    "release-notes nightly admin info office contact jobs press ops dev-team devs backend-team alerts alert monitoring notifications team team.index list announce billing service sysadmin hr mailer-daemon"
).split()
HOSTS = "mail inbox post correo courriel staff web web2 home private people team office my users".split()
LIST_HOSTS = "lists list mail code hooks bots git groups".split()
ORGS = "acme birchline cobalt-works dunmore elmstead firma garnet haldane ibex juniper-labs kestrel lumen meridian nordlicht oakhurst palisade quarry redwood silex tamarind umbra vireo westmark yarrow zenith".split()
TLDS = "example test example.com example.org example.net invalid com org net de fr es io co.uk".split()


#: What people write around a name, a mailbox, a number or an address: (before, after) by kind and language.
AROUND: dict[str, dict[str, list[tuple[str, str]]]] = {
    "name": {
        "en": [("I checked this with ", " yesterday."), ("The idea came from ", "."), ("", " will look into it next week."), ("", " wrote the patch."), ("This now belongs to ", "."), ("Assigned to ", ""), ("Owner: ", ""), ("owner = ", ""), ("Written by ", ""), ("Maintainer: ", ""), ("Reviewed-by: ", ""), ("Tested-by: ", ""), ("Co-authored-by: ", ""), ("Hello ", ","), ("Hi ", "!"), ("Dear ", ","), ("Kind regards\n", ""), ("Cheers, ", ""), ("Yours, ", ""), ("Signed, ", ""), ("cc: ", ""), ("CC ", ""), ("", " (on call)"), ("contact person: ", ""), ("Let us wait for ", "'s answer."), ("We met ", " at the office."), ('"author": "', '",'), ("name = '", "'"), ("user: ", ", role: admin"), ("assigned=", "; open"), ("Thanks, ", "!"), ("Many thanks to ", " for the help."), ("I spoke to ", " about it."), ("Talk to ", " before merging."), ("According to ", " this is fine."), ("As ", " pointed out, it is slow."), ("Approved: ", ""), ("TODO(", "): clean up"), ("FIXME(", ")"), ("@author ", ""), ("@maintainer ", ""), ("Ticket opened by ", "."), ("", " is away until Friday."), ("", " confirmed it."), ("", " and I tried it on Monday."), ("Credit goes to ", "."), ("was seen by ", " as well"), ("| ", " | open |"), ("speaker: ", ""), ("Ask ", " or me."), ("Tell ", " about it."), ("Ping ", " when it is done."), ("Call ", " back."), ("Email ", " the file."), ("Thank ", " for me."), ("Contact ", " for access."), ("See ", " in room 4."), ("Help ", " with it."), ("Ask ", " first."), ("Join ", " there."), ("", " said so."), ("User ", " logged out."), ("Customer ", " wrote twice."), ("Client ", " agreed"), ("Member ", " left."), ("Speaker ", " is late."), ("employee ", " asked"), ("let ", " in"), ("invite ", " too"), ("show ", " the way"), ("", ": I will do it"), ("by ", ""), ("from ", " to all")],
        "de": [("Verantwortlich: ", ""), ("Zuständig: ", ""), ("Die Idee kam von ", "."), ("Freigegeben von ", "."), ("Gesehen von ", "."), ("Gelesen von ", ""), ("Geändert von ", " gestern"), ("erstellt von ", "."), ("Gefunden hat es ", "."), ("Rückfragen an ", "."), ("", " kümmert sich darum."), ("", " ist im Urlaub."), ("Mit freundlichen Grüßen\n", ""), ("Viele Grüße, ", ""), ("Hallo ", ","), ("Liebe Grüße ", ""), ("Vielen Dank an ", "!"), ("Sprich mit ", ", bitte."), ("Nach Aussage von ", " läuft es."), ("Autorin: ", ""), ("Bearbeiter ", " hat zugestimmt."), ("von ", " geprüft"), ("für ", " bestimmt"), ("z. Hd. ", "")],
        "fr": [("Responsable : ", ""), ("L'idée vient de ", "."), ("Validé par ", "."), ("Écrit par ", "."), ("Demandez à ", "."), ("", " s'en occupe."), ("", " est absente."), ("Bien à vous, ", ""), ("Bonjour ", ","), ("Un grand merci à ", " !"), ("D'après ", ", tout va bien."), ("Autrice : ", ""), ("Parlez-en à ", " d'abord."), ("Trouvé par ", ""), ("pour ", " uniquement")],
        "es": [("Encargado: ", ""), ("La idea es de ", "."), ("Aprobado por ", "."), ("Escrito por ", "."), ("Pregunta a ", "."), ("", " se ocupa de ello."), ("", " no está hoy."), ("Saludos, ", ""), ("Hola ", ","), ("Muchas gracias a ", "!"), ("Como dice ", ", va bien."), ("Autora: ", ""), ("Habla con ", " primero."), ("Encontrado por ", ""), ("para ", " solamente")],
    },
    "email": {
        "en": [("Reach me at ", "."), ("Mail ", " for details."), ("My new mailbox is ", "."), ("(", ")"), ("<", ">"), ("mailto:", ""), ('email = "', '"'), ("from=", " to=all"), ("From: ", ""), ("To: ", ""), ("cc ", ""), ("login ", " is blocked"), ("address ", " rejected"), ('"mail": "', '",'), ("user ", " signed in"), ("e-mail: ", ""), ("Send it to ", " please."), ("undeliverable: ", ""), ("git config user.email ", ""), ("# ", ""), ("contact ", " instead"), ("the account of ", " expired"), ("log of ", " sent")],
        "de": [("Mail: ", ""), ("Schreib an ", "."), ("E-Mail ", " ist neu."), ("Antwort bitte an <", ">."), ("unter ", " zu erreichen")],
        "fr": [("Courriel : ", ""), ("Envoyez-le à ", "."), ("Mon adresse : ", ""), ("Répondre à <", ">."), ("compte ", " fermé")],
        "es": [("Correo: ", ""), ("Envíalo a ", "."), ("Mi dirección es ", "."), ("Responder a <", ">."), ("cuenta ", " cerrada")],
    },
    "phone": {
        "en": [("Phone: ", ""), ("Phone number: ", ""), ("Call ", " at night."), ("Call ", " if it burns."), ("Text ", " instead."), ("text: ", ""), ("SMS: ", ""), ("Duty phone: ", ""), ("Emergency line: ", ""), ("My number is ", "."), ("Ring ", " after nine."), ("tel. ", ""), ("tel ", ""), ("Cell: ", ""), ("mobile ", ", private"), ("Fax ", ""), ("dial ", " and wait"), ("phone = '", "'"), ("phone=", ";"), ("sms: [", "]"), ("call me on ", " any time"), ("hotline ", " is free"), ("reachable under ", "."), ("at ", " until noon"), ("call forwarded to ", ""), ('"tel": "', '"'), ("or ", ", whichever works"), ("| ", " |")],
        "de": [("Telefon: ", ""), ("Telefon privat: ", ""), ("SMS an ", "."), ("Anruf unter ", "."), ("Tel. ", ""), ("Ruf ", " an."), ("Handy ", ", privat"), ("Durchwahl ", ""), ("erreichbar unter ", "."), ("im Notfall ", " wählen")],
        "fr": [("Téléphone : ", ""), ("Numéro de téléphone : ", ""), ("Appel au ", "."), ("Tél. ", ""), ("Appelez le ", "."), ("Portable : ", ""), ("au ", " le soir"), ("joindre le ", " en urgence")],
        "es": [("Teléfono: ", ""), ("Teléfono de contacto: ", ""), ("Teléfono de la oficina: ", ""), ("Llamada al ", "."), ("Tel. ", ""), ("Llama al ", "."), ("Móvil: ", ""), ("en el ", " por la tarde"), ("marcar el ", " en urgencias")],
    },
    "address": {
        "en": [("Ship to ", "."), ("Office: ", ""), ("I live at ", "."), ("Postal address: ", ""), ("address = '", "'"), ('addr: "', '"'), ("Deliver to: ", ""), ("sent it to ", ", thanks"), ("Our office at ", " is closed."), ("visit us at ", ", ground floor."), ("moved to ", " in May"), ("billing_address=", ""), ("Return to ", " please."), ("the old one, ", ", is wrong"), ("lives in ", ".")],
        "de": [("Adresse: ", ""), ("Lieferung an ", "."), ("Wohnhaft ", "."), ("Büro: ", ""), ("Wir sitzen in der ", "."), ("zurück an ", ", bitte")],
        "fr": [("Adresse : ", ""), ("Livrer au ", "."), ("Bureau : ", ""), ("J'habite au ", "."), ("à renvoyer au ", ".")],
        "es": [("Dirección: ", ""), ("Entregar en ", "."), ("Oficina: ", ""), ("Vivo en ", "."), ("enviar a ", ".")],
    },
}


class Composer:
    def __init__(self, seed: int, given: list[str]):
        self.r = random.Random(seed)
        self.given = sorted({*GIVEN, *(g.capitalize() for g in given)})

    def pick(self, items):
        return self.r.choice(items)

    def maybe(self, text: str, p: float = 0.5) -> str:
        return text if self.r.random() < p else ""

    def digits(self, n: int) -> str:
        return "".join(self.r.choice(string.digits) for _ in range(n))

    def fill(self, shape: str) -> str:
        return "".join(self.r.choice(string.digits) if c == "0" else self.r.choice(string.ascii_uppercase) if c == "A" else c for c in shape)

    # names ------------------------------------------------------------------

    def family(self) -> str:
        return (self.pick(STEMS_A) + self.maybe(self.pick(STEMS_B)) + self.pick(ENDINGS)).capitalize()

    def name(self) -> tuple[str, str, str]:
        """(as written, given, family)"""
        given, family = self.pick(self.given), self.family()
        if self.r.random() < 0.12:  # given names no list holds, and short families
            given = (self.pick(STEMS_A) + self.maybe(self.pick("a o i us el an ina eth wyn ji".split()), 0.7)).capitalize()
        if self.r.random() < 0.15:
            family = self.pick(FAMILIES)
        shown = given
        if self.r.random() < 0.08:
            shown = f"{given}-{self.pick(self.given)}"
        written = family
        x = self.r.random()
        if x < 0.15:
            written = f"{family}-{self.family()}"
        elif x < 0.3:
            written = self.pick(["van der ", "von ", "de la ", "de ", "Mac", "Mc", "O'", "di ", "van ", "du "]) + family
        if self.r.random() < 0.1:
            written = " ".join(w if w.islower() and self.r.random() < 0.7 else w.upper() for w in written.split(" "))
        x = self.r.random()
        if x < 0.12:
            text = f"{written}, {shown}"
        elif x < 0.24:
            text = f"{given[0]}. {written}"
        elif x < 0.36:
            text = f"{shown} {self.pick(string.ascii_uppercase)}. {written}"
        elif x < 0.4:
            text = f"{given[0]}. {self.pick(string.ascii_uppercase)}. {written}"
        else:
            text = f"{shown} {written}"
        # Names written small are only looked for beside given names that are known.
        if self.r.random() < 0.05 and ". " not in text and given in self.given:
            text = text.lower()
        if self.r.random() < 0.07:  # the family's name first, as in parts of Asia
            family, given = self.pick(EASTERN), self.pick(SYLLABLES).capitalize() + self.maybe(self.pick(SYLLABLES), 0.6)
            text = f"{family} {given}" if self.r.random() < 0.7 else f"{family} {self.pick(SYLLABLES).capitalize()} {self.pick(SYLLABLES).capitalize()}"
        if self.r.random() < 0.04:
            given, family = self.pick(self.given), self.pick(["Al-", "El-", "Ben "]) + self.pick(SYLLABLES + STEMS_A).capitalize() + self.pick(["", "i", "id", "am", "ar"])
            text, family = f"{given} {family}", family[3:].strip("- ")
        return text, given, family

    # addresses and numbers ----------------------------------------------------

    def mailbox(self, given: str, family: str) -> str:
        g, f = fold(given), fold(family)
        local = self.pick([f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{g[0]}.{f}", f"{g[0]}{f}", f"{f}.{g}", f"{f}{self.digits(2)}", f"{f}{self.digits(1)}", f, f"{g[0]}{f}", f"{g}{f}"])
        return local + self.maybe("+" + self.pick(NOUNS), 0.12)

    def spelled(self, address: str) -> str:
        x = self.r.random()
        if x < 0.62:
            return address
        if x < 0.72:
            return address.upper()
        local, domain = address.split("@")
        if x < 0.84:
            return f"{local} at {domain.replace('.', ' dot ')}"
        return f"{local}{self.pick([' [at] ', '[at]', ' (at) ', '(at)', ' @ '])}{domain}"

    def email(self) -> str:
        return self.spelled(f"{self.mailbox(self.pick(self.given), self.family())}@{self.domain()}")

    def domain(self, hosts=HOSTS) -> str:
        x = self.r.random()
        tld = self.pick(TLDS[:3]) if self.r.random() < 0.6 else self.pick(TLDS)
        return (self.pick(hosts) + "." if x < 0.6 else "") + self.pick(ORGS) + "." + tld

    def phone(self) -> str:
        shape = self.pick(
            "+0 (000) 000-0000|(000) 000-0000|000-000-0000|000.000.0000|+00000000000|00000000000|+00 0000 000000|+00 (0)0000 000 000|00000 000000|"
            "(000) 00000 000|+00 00 00000 000|0000 00 00000000|+00 (0)00 00000-000|000/00000-000|00 00 00 00 00|00.00.00.00.00|0000000 000000|"
            "+00 0 00 00 00 00|000 000 000|(+00) 000-000-000|+00 000 000 000|+0000000000|000/00000000|0000 000 000".split("|")
        )
        number = self.fill(shape)
        if shape[0] == "0" and shape not in ("000-000-0000", "000.000.0000", "000 000 000"):
            number = "0" + number[1:]
            if shape in ("0000 00 00000000", "0000000 000000"):
                number = "00" + number[2:]
        if shape == "000 000 000":
            number = "9" + number[1:]
        if shape == "(000) 00000 000":
            number = "(0" + number[2:]
        if self.r.random() < 0.06:
            number = number.replace(" ", " ")
        if self.r.random() < 0.05:
            number = number.replace("-", "–")
        return number

    def identity(self, lang: str) -> tuple[str, str]:
        """(label, number)"""
        label, shape = self.pick(
            {
                "en": [("SSN", "000-00-0000"), ("social security number", "000 00 0000"), ("NI number", "QQ 00 00 00 C"), ("national insurance number", "QQ000000C"), ("national insurance no.", "QQ 00 00 00 C"), ("NINO", "QQ000000C"), ("SSN no.", "000-00-0000"), ("passport", "X00000000"), ("passport no.", "00-000000-Z"), ("passport number", "000000000")],
                "de": [("Steuer-ID", "00 000 000 000"), ("Ausweisnummer", "T00000000"), ("Personalausweis Nr.", "T00000000D<<"), ("Reisepass", "C00000000"), ("Steuer-ID", "00000000000")],
                "fr": [("NIR", "1000000000000"), ("n° de sécurité sociale", "2 00 00 00 000 000"), ("passeport n°", "00XZ00000"), ("NIR", "2 00 00 00 000 000 00")],
                "es": [("DNI", "00000000-Z"), ("NIE", "X-0000000-Z"), ("DNI n.º", "00.000.000-T"), ("DNI", "00000000Z"), ("pasaporte", "AAA000000")],
            }[lang]
        )
        number = "".join(self.r.choice(string.digits) if c == "0" else c for c in shape)
        if shape.endswith(("-Z", "-T", "0Z")) or shape.startswith("QQ"):
            number = number[:-1] + self.pick(string.ascii_uppercase[:4] if shape.startswith("QQ") else string.ascii_uppercase)
        if shape == "AAA000000":
            number = "".join(self.pick(string.ascii_uppercase) for _ in range(2)) + self.digits(7)
        return label, number

    def town(self) -> str:
        town = self.pick(TOWN_A) + self.pick(TOWN_B)
        if self.r.random() < 0.15:
            town = self.pick("London Leeds Boston Denver Austin Dublin Berlin Hamburg München Köln Bremen Wien Lyon Paris Nantes Lille Toulouse Madrid Sevilla Valencia Bilbao Toledo Washington Springfield Portland".split())
        if self.r.random() < 0.03:
            return self.pick(["San ", "Santa ", "New ", "Saint ", "Bad ", "La ", "Port ", "Great "]) + town
        return town

    def street_name(self) -> str:
        return (self.pick(STEMS_A) + self.maybe(self.pick(STEMS_B))).capitalize() + self.pick(["", "gate", "wood", "field", "bridge", "hill"])

    def address(self, lang: str) -> str:
        gap = "\n" if self.r.random() < 0.25 else " "
        n = self.r.randint(1, 250)
        code = self.digits(5)
        if lang == "en":
            kind = self.pick("Road Street Lane Ave Avenue St Drive Close Court Crescent Terrace Blvd. Blvd Rd. St. Way Place Square".split())
            street = f"{n}{self.maybe(self.pick('AB'), 0.15)} {self.street_name()} {kind}"
            if self.r.random() < 0.25:
                street = f"Flat {self.r.randint(1, 40)}, {street}"
            elif self.r.random() < 0.2:
                street += f", Apt {self.r.randint(1, 60)}"
            if self.r.random() < 0.08 and not street.endswith(".") and "Apt" not in street:
                street += " " + self.pick("NW NE SW SE".split())
            if self.r.random() < 0.35:
                return street
            ending = self.pick([f", {self.fill('AA')} {code}", f", {self.fill('AA')} {code}", f" {self.fill('AA')} {code}", f" {self.fill(self.pick(['AA0 0AA', 'A00 0AA', 'AA00 0AA', 'A0A 0AA']))}", f", {self.fill('AA00 0AA')}"])
            return f"{street},{gap}{self.town()}" + self.maybe(ending, 0.5)
        if lang == "de":
            street = self.pick([f"{self.street_name()}{self.pick(['straße', 'str.', 'weg', 'platz', 'gasse'])}", f"{self.street_name()}-Allee", f"Am {self.street_name()}bach", f"{self.street_name()}-Straße"])
            street += f" {n}{self.maybe(self.pick('ab'), 0.2)}"
            return street if self.r.random() < 0.35 else f"{street},{gap}{code} {self.town()}"
        if lang == "es":
            street = self.pick([f"C/ {self.street_name()} {n}", f"Calle {self.street_name()} {n}, {self.r.randint(1, 9)}.º {self.pick('ABC')}", f"Avda. {self.street_name()}, {n}", f"Plaza del {self.street_name()}, n.º {n}"])
            if street.startswith("Plaza"):
                return f"{street},{gap}{self.town()}"
            return street if self.r.random() < 0.3 else f"{street},{gap}{code} {self.town()}"
        street = self.pick([f"{n}, rue des {self.street_name()}s", f"{n} bis, avenue {self.street_name()}", f"{n} chemin du {self.street_name()}", f"{n} place {self.street_name()}", f"{n}, rue de {self.street_name()}"])
        if "chemin" in street:
            return f"{street},{gap}{self.town()}"
        return street if self.r.random() < 0.3 else f"{street},{gap}{code} {self.town()}"

    # text around -----------------------------------------------------------------

    def code(self) -> str:
        a, b = self.pick(VERBS), self.pick(NOUNS)
        return self.pick([f"{a}_{b}", f"{a}{b.capitalize()}", f"{b.capitalize()}{a.capitalize()}", f"{a.upper()}_{b.upper()}", f"{b.capitalize()}", f"core::{b}::{a}", f"app/{b}.rs", f"tools/{b}_{a}.py", f"`{b}`"])

    def words(self, lang: str, n: int) -> str:
        """A run of words without sense, so that no neighbour but a telling one gains weight."""
        out = []
        for i in range(n):
            out.append(self.pick(SMALL[lang]) if i % 2 else self.pick(NOUNS if self.r.random() < 0.6 else ADJECTIVES))
        return " ".join(out)

    def filler(self, lang: str) -> str:
        n, m, c = self.r.randint(2, 999), self.r.randint(100, 9999), self.code()
        w, v, x, a, do = self.pick(NOUNS), self.pick(NOUNS), self.pick(NOUNS), self.pick(ADJECTIVES), self.pick(VERBS)
        if self.r.random() < 0.3:  # some given names are words too
            w = self.pick("grant rose mark miles dale ivy hugh joan will may jordan victor clara noel heike dawn robin jasmine ruby amber frank art".split())
        lead = self.maybe(self.pick({"en": [f"{self.pick(CAPITALS_DE)}. {self.pick(CAPITALS_DE)}: ", "By the way: ", f"As of {self.r.randint(0, 4)}.{n % 20}: ", f"About #{m}: ", f"{w.capitalize()} notes: ", f"Regarding {c}: ", f"{n} lines later: "], "de": ["Übrigens: ", "Erledigt: ", f"Ab {n % 9}.{n % 20}: ", f"Zu {c}: "], "fr": ["Au fait : ", "Reste ouvert : ", f"Pour {c} : "], "es": ["Por cierto: ", "Pendiente: ", f"Sobre {c}: "]}[lang]), 0.35)
        if self.r.random() < 0.45:
            run = f"{self.pick(STARTS[lang])} " + self.words(lang, self.r.randint(3, 12))
            if self.r.random() < 0.5:  # capitals within a sentence
                shown = self.pick([w.capitalize(), c, v.upper(), f"{do}_{v}".upper(), self.pick(CAPITALS_DE) if lang == "de" else x.capitalize()])
                run = self.pick([f"{self.pick(STARTS[lang])} {shown} {run.lower()}", f"{run} {shown} {self.words(lang, 2)}", f"{do.capitalize()} {shown} {run.lower()}", f"{self.pick(SMALL[lang] + STEMS_A).capitalize()}{self.pick(['amos', 'en', 'ons', 'er', 'ar'])} {shown} {run.lower()}", f"{run} {self.pick(STARTS[lang])} {shown}"])
            return lead + run + self.pick([".", ".", "?", ":", ""])
        return lead + self.pick(
            {
                "en": [f"The {a} {w} {do}s its {v} twice, see {c}.", f"{w.capitalize()} {v} and {x} {v} {do} the {a} {w}.", f"On line {n} of {c} the {w} is {a}.", f"Each {w} holds {n} {v}s and one {a} {x}.", f"Every {w} {do}s {m} ms before the {v}.", f"Can {c} {do} a {w}?", f"Move the {w} {v} below {c}, please.", f"{c}: {a} {w} {x}", f"Version {n % 9}.{n % 20} {do}s the {w} {v}.", f"If a {w} is {a}, {do} it and {do} the {v} again.", f"{w.capitalize()} {do}ing was {a} on {n} {v}s.", f"- {do} {w}\n- {do} {a} {v}s", f"We {do} {w} {v}s, {x} {v}s and {c}.", f"let {w} = {do}({v}, {n});", f"{w}: {do} the {a} {v}", f"# {a.capitalize()} {w}", f"## {w.capitalize()}"],
                "de": [f"{self.pick(STARTS['de'])} {self.pick(CAPITALS_DE)} {self.pick(['auf', 'in', 'bei', 'von', 'gehört', 'ist', 'wird', 'hat'])} {c} {self.words('de', 3)}.", f"{self.pick(STARTS['de'])} {self.pick(CAPITALS_DE)} {self.pick(STARTS['de']).lower()} {self.pick(CAPITALS_DE)} {self.pick(['fehlt', 'bleibt', 'stimmt', 'genügt'])}.", f"{self.pick(CAPITALS_DE)} {self.pick(CAPITALS_DE)}", f"In {c} steht ein {a}es {w} auf Zeile {n}.", f"Das {w.capitalize()} wird vor dem {v.capitalize()} gelesen.", f"Nach {m} ms endet der Lauf von {c}.", f"{w.capitalize()} und {v.capitalize()} bleiben, wie sie sind.", f"Wer {c} ändert, muss auch {n} Tests ändern.", f"Ohne {w.capitalize()} startet {c} nicht.", f"Die {w.capitalize()}-Liste hat {n} Einträge."],
                "fr": [f"Le {w} de {c} se trouve ligne {n}.", f"Sans {w}, {c} ne démarre pas.", f"On garde {n} {v}s et un {w}.", f"Après {m} ms, {c} s'arrête.", f"Le {w} et le {v} restent en place.", f"Qui change {c} change aussi le {w}."],
                "es": [f"El {w} de {c} está en la línea {n}.", f"Sin {w}, {c} no arranca.", f"Quedan {n} {v}s y un {w}.", f"Tras {m} ms, {c} se detiene.", f"El {w} y el {v} siguen igual.", f"Quien cambia {c} cambia también el {w}."],
            }[lang]
        )

    def decoy(self) -> str:
        g, h, w, v, n = self.pick(self.given), self.pick(self.given), self.pick(NOUNS), self.pick(NOUNS), self.r.randint(2, 999)
        role, do, a = self.pick(ROLES), self.pick(VERBS), self.pick(ADJECTIVES)
        lists = f"{role}@{self.domain(LIST_HOSTS if self.r.random() < 0.5 else HOSTS)}"
        street = self.pick(["Street", "Road", "Hill", "Square", "Lane", "Park", "Court", "Lake"])
        return self.pick(
            [
                f"{self.pick(['The ', 'A ', 'Our ', ''])}{g} {self.pick(['engine', 'filter', 'transform', 'distance', w])} {do}s the {h} {v}.",
                f"{self.pick(['The', 'This', 'Our'])} {g} {w} is {a}.",
                f"{self.pick(['Class', 'Module', 'Package', 'Project'])} {g} {street} {self.pick(['Parser', 'Reader', w.capitalize(), 'Index'])} {do}s a {w}.",
                f"{self.pick(['Milestone', 'Sprint', 'Release', 'Version', 'Branch'])} {g} {street} {self.pick(['shipped', 'is out', 'was cut', f'has {n} fixes'])}.",
                f"{g} {self.pick(['codes', 'points', 'trees', 'curves', w])} {self.pick(['fail', 'pass', 'drift', 'match'])} for {n} {v}s.",
                f"{g.lower()} {w} {a}, {g.lower()} {v}s not",
                f"{do} {g.lower()} {do}s, then {do} {h.lower()}",
                f"{g.lower()} {self.pick(NOUNS)} {self.pick(NOUNS)}: {a}",
                f"{g} {w} {v} {self.pick(['passes', 'fails', 'hangs'])} again.",
                f"{n} {self.pick(['Baker', 'Main', 'Lake', 'Park', g])}-{self.pick(['like', 'style', 'sized', 'type'])} {w}s {self.pick(['on the', 'in the', 'of our'])} {self.pick(['road', 'street', 'lane'])} {self.pick(['map', 'view', 'graph'])}.",
                f"git clone git@{self.domain(LIST_HOSTS)}:{w}/{v}.git",
                f"{self.pick(['Remote', 'Origin', 'Mirror'])} ssh://git@{self.domain(LIST_HOSTS)}/{w}.git {self.pick(['is read-only', 'moved', ''])}",
                f"{self.pick(['npm i', 'Needs', 'Uses', 'Depends on'])} @{self.pick(ORGS)}/{w}@{n % 9}.{n % 20}.{n % 7}{self.pick(['', ' today', '.'])}",
                f"{self.pick(['label', 'The key', 'Account'])} `{self.pick(['user', 'host', 'root', 'admin'])}@{w}` {self.pick(['is local', 'stays', 'means nothing'])}.",
                f"{self.pick(['Regex', 'A rule like', 'Try'])} `{self.pick(['[a-z]+@[a-z]+', '[^@]+@[^@]+', '.+@.+', '\\\\w+@\\\\w+'])}` {self.pick(['is too wide', 'hits the lot', 'is naive'])}.",
                f"{self.pick(['Mail from', 'Answers to', 'Questions? ', 'Subscribe at', 'Goes out as', 'Sender:', 'Reports to', 'Cc', 'Automated by', 'Ping', 'Bei Fragen an', 'Écrivez à', 'Escriba a', 'Reply-To:', 'via'])} {self.spelled(lists)}{self.pick([' every night', '.', '', ' for help', ' on each build'])}",
                f"{self.words('en', self.r.randint(1, 5))} {self.pick(['a', 'the', 'one', 'its', 'each'])} {self.pick([g, 'grant', 'mark', 'rose', 'may', 'will']).lower()} {self.pick([v, do + 's', a, self.pick(SMALL['en'])])}{self.pick([', so ', ' ', '. ', '; '])}{self.words('en', 3)}",
                f"{self.words('en', self.r.randint(1, 4))} {self.spelled(lists)} {self.words('en', 2)}",
                f"{self.pick(VERBS).capitalize()} the {self.pick(['list', 'team', 'bot', 'desk', 'group'])} at {lists}{self.pick(['.', '', ' first'])}",
                f"{w}{self.pick([' ', ': ', ' no. ', ', ' + v + ' '])}{self.fill(self.pick(['00000-0000', '0000-0000', '00000-0000-0000', '0000000.00.0000', '000000000', '00000000000']))}{self.pick(['', '.', ' ' + v])}",
                f"{self.pick(['from:', 'to=', '<', '(', 'mailto:'])}{lists}{self.pick(['', '>', ')', ';'])}",
                f"{self.pick(['Trace', 'Span', 'Run', 'Job', 'Request'])} {self.pick(['', 'id ', 'no. ', '#'])}{self.fill(self.pick(['00000-0000-0000', '0000-0000-0000', '00000-0000-000', '000000-0000', '0000-000000']))} {self.pick(['ended', 'hangs', 'was retried', 'comes first', 'is part of it'])}.",
                f"{self.pick(['week', 'Calendar week', 'Date', 'Since'])} 202{n % 10}-{self.pick(['W', '0', '1'])}{self.digits(1)}{self.pick(['-', ', '])}{self.pick(['batch', 'build', 'item'])} {self.fill(self.pick(['00000-0000', '0000-0000', '000-0000', '00-000-00']))}",
                f"202{n % 10}-0{self.r.randint(1, 9)}-1{n % 9}{self.pick([' ', 'T'])}1{n % 9}:0{n % 9}:2{n % 9}{self.pick(['', 'Z', ' start'])} {self.fill(self.pick(['0000000.00.0000', '000000.00.0000', '0000000.0.0000', '00000000000']))}",
                f"{self.pick(['Host', 'Bind', 'Ping', 'Node'])} {self.pick(['10', '192.168', '172.16'])}.{n % 250}.{n % 9}{self.pick(['.1', '', '.20'])}:{self.digits(4)} {self.pick(['is up', 'is down', 'answers'])}.",
                f"{self.digits(3)}.{self.digits(2)}.{self.digits(3)}.{self.digits(1)} {self.pick(['is its address', 'answers', 'as address'])}",
                f"{self.pick(['from', 'addr', 'span'])} 0x{self.digits(8)} {self.pick(['to', '-', '..'])} 0x{self.digits(8)}, {self.digits(3)}-{self.digits(2)} {w}s",
                f"0x{self.digits(8)}{self.pick(['..', '-', ' '])}0x{self.digits(8)}",
                f"{self.pick(['Ticket', 'Case', 'Incident', 'See'])} {self.pick(['TKT', 'INC', 'BUG', 'REQ', 'CASE'])}-{self.digits(4)}-{self.digits(self.r.randint(2, 4))} {self.pick(['is done', 'stays open', 'was merged'])}.",
                f"{self.pick(['Checksum', 'Digest', 'Hash', 'Commit'])} {self.digits(self.pick([8, 9, 10, 11, 12, 16]))} {self.pick(['differs', 'is fine', 'was expected'])}{self.pick(['', f', size {self.digits(9)}'])}.",
                f'{self.pick(["param", "field", "node"])} {self.pick(["name", "title", "label"])}="{self.pick([w, g.lower()])} {v}" {self.pick(["kind", "type", "phone", "email"])}={self.pick(["none", "null", "0"])}',
                f"{self.pick(['Order', 'Invoice', 'Item', 'Batch', 'Lot', 'Row', 'Serial'])} {self.pick(['', 'no. ', '#'])}{self.digits(self.pick([7, 8, 9, 10, 11, 12]))} {self.pick([f'of lot {self.digits(11)}', 'was shipped', 'is late', f'and {self.digits(9)}'])}.",
                f"{self.pick(['Total', 'Size', 'Count', 'Reads', 'Sum'])}{self.pick([': ', ' ', ' = '])}{self.digits(3)} {self.digits(3)} {self.digits(3)} {self.pick(['bytes', 'rows', 'ms', w + 's'])}",
                f"{self.pick(['release', 'version', 'v', 'build'])} {self.digits(2)}.{self.digits(3)}.{self.digits(3)} {self.pick(['of ' + w, 'is old', ''])}",
                f"{self.pick(['Main', 'Old', 'New', 'Central', 'Open'])} {self.pick(['Parser', 'Reader', 'Source', 'Office', w.capitalize()])} {self.pick(['is', 'was'])} {a}.",
                f"{self.pick(['The', 'This', 'Our', 'Every', 'One', 'Das', 'Der', 'Die', 'El', 'La', 'Le', 'Un', 'Una', 'Ein'])} {w.capitalize()} {self.pick([v, v.capitalize()])} {self.pick(['is', 'ist', 'est', 'es'])} {a}.",
                f"{self.pick(['Please', 'Contact', 'Ask', 'See', 'Read', 'Hello', 'Dear', 'Thanks'])} {self.pick(['Support', 'Sales', 'Team', 'Help', 'Everyone', 'All'])} {self.pick(['Desk', 'Page', 'Center', 'Lead', 'Members'])}",
                f"{self.pick(['Monday', 'January', 'Friday', 'March'])} {self.pick(['Meeting', 'Release', 'Review', 'Standup'])} at {n % 12}:30",
                f"{w.capitalize()} {v.capitalize()} {self.pick(['Service', 'Guide', 'Manual', 'Interface', 'License', 'Protocol'])}",
                f"{g.lower()}_{w} = {g}{w.capitalize()}({n})",
            ]
        )

    def around(self, kind: str, lang: str, label: str = "") -> tuple[str, str]:
        """What stands before and after an entity."""
        x = self.r.random()
        if kind == "phone" and x < 0.1:  # beside dates
            dates = " ".join(f"20{self.digits(2)}-0{self.r.randint(1, 9)}-{self.r.randint(10, 28)}" for _ in range(self.r.randint(1, 3)))
            label = self.maybe(self.pick(["Tel.: ", "Phone: ", "tel ", "Fax "]), 0.4)
            return self.pick([(f"{label}{dates} ", ""), (f"{label}{dates} ", ""), (label, f" {dates}"), (f"{dates} {label}", "")])
        if x < 0.22:  # words that tell nothing
            return self.words(lang, self.r.randint(1, 5)) + self.pick([" ", " ", ": ", " - "]), self.pick([" ", ", ", ". ", "; "]) + self.words(lang, self.r.randint(1, 4))
        if x < 0.3:
            return self.pick([("", ""), ("(", ")"), ("[", "]"), ("- ", ""), ("* ", ";"), ("| ", " |"), ('"', '"'), ("'", "'"), ("> ", ""), ("\t", "\t"), (f"{self.r.randint(1, 30)}. ", ""), ("# ", ""), ("// ", ""), ("-- ", "")])
        return self.pick(AROUND[kind][lang])

    def sentence(self, lang: str) -> list[tuple[str, str | None]]:
        """Parts of a sentence with the kind of those that are personal."""
        x = self.r.random()
        if x < 0.36:
            name = self.name()[0]
            title = self.maybe(self.pick({"en": ["Dr. ", "Dr ", "Mrs ", "Mr ", "Mr. ", "Ms ", "Prof. "], "de": ["Herr ", "Herrn ", "Frau ", "Dr. ", "Prof. "], "fr": ["Mme ", "M. ", "Dr "], "es": ["la Sra. ", "el Sr. ", "la Dra. ", "don ", "doña "]}[lang]), 0.2)
            before, after = self.around("name", lang)
            if self.r.random() < 0.06:
                return [(before + title, None), (name, "name"), (self.pick([" and ", ", ", " & ", "; ", " / ", "\n"]), None), (self.name()[0], "name"), (after, None)]
            return [(before + title, None), (name, "name"), (after, None)]
        if x < 0.42:
            name, given, family = self.name()
            mail = self.spelled(f"{self.mailbox(given, family)}@{self.domain()}")
            return self.pick(
                [
                    [(self.pick(["Signed-off-by: ", "Acked-by: ", "Author: ", "Tested-by: ", "From: ", "To: ", "Co-authored-by: "]), None), (name, "name"), (" <", None), (mail, "email"), (">", None)],
                    [(self.pick(["| ", "| row | ", "- "]), None), (name, "name"), (" | ", None), (mail, "email"), (" |", None)],
                    [(self.pick(["-- \n", "—\n", "Best regards\n", "Gruß\n", "Saludos\n"]), None), (name, "name"), ("\n", None), (mail, "email"), (self.pick([" | ", "\n", ", "]), None), (self.phone(), "phone")],
                    [("", None), (name, "name"), (self.pick([", ", " (", " - "]), None), (mail, "email"), (self.pick(["", ")", ", "]), None)],
                    [(self.pick(["", "Customer ", "Guest: "]), None), (name, "name"), (self.pick([", ", " (", ": ", ", tel. "]), None), (self.phone(), "phone"), (self.pick(["", ")", " "]), None)],
                ]
            )
        if x < 0.56:
            before, after = self.around("email", lang)
            return [(before, None), (self.email(), "email"), (after, None)]
        if x < 0.72:
            before, after = self.around("phone", lang)
            return [(before, None), (self.phone(), "phone"), (after, None)]
        if x < 0.86:
            label, number = self.identity(lang)
            before, after = self.pick(
                [
                    (f"{label}{self.pick([': ', ' : ', ' ', ' = ', ' (', '; '])}", self.pick(["", ".", ")", ",", " " + self.pick(NOUNS)])),
                    (f"{self.words(lang, self.r.randint(1, 4))} {label} ", self.pick([".", "", f" {self.words(lang, 2)}", ","])),
                    (f"{self.pick({'en': ['his ', 'her ', 'my ', 'a valid ', 'their ', 'leaks the '], 'de': ['meine ', 'die ', 'seine ', 'samt '], 'fr': ['son ', 'mon ', 'avec le ', 'un '], 'es': ['su ', 'mi ', 'con el ', 'un ']}[lang])}{label} ", self.pick(["", ".", ")", " " + self.pick(NOUNS)])),
                    (f'{self.pick(["id", "value", "doc", "x.id"])}{self.pick([": ", " == ", "="])}"', f'"  {self.pick(["#", "//", "--"])} {label}'),
                ]
            )
            return [(before, None), (number, "id_number"), (after, None)]
        before, after = self.around("address", lang)
        text = self.address(lang)
        if text.endswith(".") and after.startswith("."):
            after = after[1:]
        if self.r.random() < 0.35:  # the next sentence follows at once
            first = self.pick([self.pick(STARTS[lang]), self.pick(STARTS[lang]), self.pick(NOUNS).capitalize(), self.pick(ADJECTIVES).capitalize(), self.pick(VERBS).capitalize(), self.pick(CAPITALS_DE)])
            after = f" {first}" + self.pick([" ", " ", " ", ": ", "-"]) + self.words(lang, 3)
        return [(before, None), (text, "address"), (after, None)]

    def example(self) -> tuple[str, list[tuple[int, int, str]]]:
        parts: list[tuple[str, str | None]] = []
        for _ in range(self.r.randint(1, 3)):
            lang = self.pick(["en", "en", "de", "fr", "es"])
            x = self.r.random()
            parts += self.sentence(lang) if x < 0.55 else [(self.decoy() if x < 0.78 else self.filler(lang), None)]
            parts.append((self.pick([" ", " ", "\n", "\n\n", "\n- ", "\r\n"]), None))
        text, labels = "", []
        for part, kind in parts:
            if kind:
                labels.append((len(text), len(text) + len(part), kind))
            text += part
        return text, labels


def compose(n: int, seed: int, given: list[str]) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n labelled texts; same arguments, same texts."""
    composer = Composer(seed, given)
    return [composer.example() for _ in range(n)]
