"""Recall and precision of the recogniser on texts labelled by hand.

None of these texts was composed by the training module or comes from the test
tables: they are letters, minutes, tickets and log lines as people write them.
Entities are marked {kind:text}.
"""

import re

from quern.llm import pii
from quern.llm.pii_training import GIVEN

TEXTS = """
Minutes, 3 June. Present: {name:Siobhan Gallagher}, {name:Krzysztof Nowak}, {name:Nguyen Van Anh}. Apologies from {name:Dr. Okafor|}.
Sehr geehrter Herr {name:Krzysztof Nowak}, Ihre Anfrage vom Montag liegt jetzt bei der Technik.
Can somebody let {name:Wang Xiaoming} into the server room tomorrow?
The lease was signed by {name:Margaret O'Donnell} and {name:Peter van den Berg} last autumn.
President's office: {address:1600 Pennsylvania Avenue NW, Washington, DC 20500}
Parcel for {name:Hannah Lindqvist}, {address:12 Orchard Lane, Leeds LS1 4AB}, leave with the neighbour.
The pump is at {address:47 Mill Road, Cambridge} and the spare key is under the stone.
Lieferanschrift: {address:Gartenstraße 14, 50667 Köln}, Klingel beim Hausmeister.
Das Büro zieht um: ab März {address:Lindenallee 8a, 20259 Hamburg}.
Rendez-vous au {address:25 rue de Rivoli, 75004 Paris} demain matin.
El paquete va a {address:Calle Mayor 18, 28013 Madrid}, tercer timbre.
If the alarm rings again phone {phone:+44 20 7946 0958} and ask for {name:Imran Khan}.
Mein neues Handy: {phone:0151 23456789}, bitte nicht weitergeben.
You can leave a message on {phone:(415) 555-0132} or {phone:415-555-0199}.
Joignez-moi au {phone:06 12 34 56 78} après 18 h.
Mi móvil es el {phone:+34 612 345 678}.
New hire paperwork: SSN {id_number:078-05-1120}, start date 1 July 2024.
Passport number {id_number:X12345678} expires in 2031.
Mi DNI es {id_number:12345678-Z} por si lo necesitas.
Steuer-ID: {id_number:12 345 678 901}
National insurance: NI number {id_number:QQ 12 34 56 C} on the payslip.
Numéro de sécurité sociale : NIR {id_number:1 85 05 78 006 084 36}
please forward invoices to {email:fiona.mcbride@harbourlight.example} before noon
her private one is {email:tomasz87@poczta.example}, the old address bounces
{email:j.alvarez at correo dot example} was typed by hand
Bounced: {email:HELGA.SCHUSTER@KANZLEI.EXAMPLE}
write {email:ravi.iyer+billing@cedar.example.org}; never the shared one support@cedar.example.org
The nightly report comes from no-reply@status.example.com and needs no answer.
Clone via git@code.example.com:tools/spinner.git, then run make.
Patch by {name:Yuki Tanaka} <{email:yuki.tanaka@lab.example.jp}>
Reviewed with {name:Amara Diallo}; she found two leaks.
Subject: farewell. After nine years {name:Giulia Ferrari} is leaving the company.
{name:Oskar Lindholm} wrote: I think we should keep both branches.
Au nom de l'équipe, merci à {name:Benoît Charpentier} pour sa patience.
La ponencia de {name:Lucía Fernández} fue la mejor del congreso.
Der Vortrag von {name:Annegret Schulze-Hoffmann} beginnt um zehn.
Danke, {name:Jürgen}|
Customer {name:Chloe Bennett} ({phone:07911 123456}) called about order 20240613.
Applicant: {name:Müller, Sabine}; position: accountant
{name:J. R. Whitfield} countersigned the contract on page 7.
User {name:Ahmed Hassan} reset the password twice on 2024-03-05 14:22:10.
Meeting room Rose Garden is booked, try Grant Hall.
The Hamilton filter beats the Kalman filter on this series.
Jordan algebra and Victor charts are unrelated topics.
Build 20240611.3 took 00:12:45, artifact 8f3e2b1c99.
Server 192.168.10.24 answers on port 8443.
Order 4820193847 contains 12 items at 3.49 each.
Version 12.345.678 of the Maple Street Library was yanked.
ISBN 978-3-16-148410-0 is on the reading list.
The Old Mill pub on Baker Street corner has good coffee.
Montag und Dienstag bleibt die Werkstatt geschlossen.
Le Petit Prince est sur la table.
New York Times and Wall Street Journal both ran the story.
Please Contact Support Desk for any question.
function renderPage(width, height) { return width * height / 300; }
commit 5d41402abc4b2a76b9719d911017c592 touches 14 files
Ticket INC-2024-00317 duplicates INC-2024-00298.
Ask {name:Declan Murphy} whether {name:Ingrid Solberg} still has the charger.
{name:Mohammed Al-Rashid} approved it; {name:Elif Yıldız} deployed it.
Signed-off-by: {name:Pavel Dvořák} <{email:pavel.dvorak@sklad.example}>
Return address: {address:9 Harbour View Terrace, Brighton BN1 2RE}
Visit {address:221B Baker Street, London} if you like detectives.
Kontakt: {name:Dieter Baumgartner}, {phone:+49 89 1234567}, {email:d.baumgartner@werk.example}
""".strip().split("\n")

_MARK = re.compile(r"\{(email|phone|id_number|address|name):([^{}|]*)(\|?)\}\|?")


def labelled(line):
    """(text, spans); an entity marked with a bar may be found or not."""
    text, spans, free, at = "", set(), set(), 0
    for m in _MARK.finditer(line):
        text += line[at : m.start()]
        (free if "|" in m.group(0) else spans).add((len(text), len(text) + len(m.group(2)), m.group(1)))
        text += m.group(2)
        at = m.end()
    return text + line[at:], spans, free


def test_recall_and_precision_on_labelled_texts():
    given = frozenset(pii.fold(n) for n in GIVEN)
    weights = pii.trained(given)
    right = wanted = found = 0
    wrong = []
    for line in TEXTS:
        text, spans, free = labelled(line)
        got = {(s.start, s.end, s.kind) for s in pii.find_spans(text, weights, given)}
        got = {g for g in got if not any(g[0] < e and a < g[1] for a, e, _ in free)}
        right, wanted, found = right + len(got & spans), wanted + len(spans), found + len(got)
        wrong += [(kind, text[a:e], "extra") for a, e, kind in got - spans] + [(kind, text[a:e], "missed") for a, e, kind in spans - got]
    assert wanted > 50
    print(right, wanted, found, wrong)
    assert right / wanted >= 0.9 and right / found >= 0.9
