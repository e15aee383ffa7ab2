"""Hand-written sentences on which the personal-information tagger is measured; none of its training sentences, names or places is used here.

Entities are written {kind:text}; kinds are n (name), e (email), p (phone), i (identity number), a (street address).
"""

from __future__ import annotations

import re

_KINDS = {"n": "name", "e": "email", "p": "phone", "i": "identity_number", "a": "street_address"}

SENTENCES = r"""
Yesterday {n:Callum Fairweather} walked us through the incident timeline.
The pull request from {n:Mohammed El-Sayed} still lacks a unit test.
We owe this finding to {n:Siobhan O'Leary}, who spotted it while on leave.
Her doctor, {n:Leonora Quigley}, faxed the results to {p:+1 (312) 555-0182}.
If the door stays shut, our caretaker {n:Barnaby Thistlewood} answers at {p:07700 900123}.
Headquarters sits at {a:2400 Bayshore Parkway, Sunnyvale, CA 94043} since the merger.
Package for {n:Priscilla Vandermeer}: leave it at {a:18 Rosebery Crescent, Jesmond NE2 1EU}.
Interviewer's remark: applicant {n:Thandiwe Mokoena} brought her passport {i:M00123456}.
Candidate {n:Oluwaseun Bakare} can start in May; his tax number is {i:12 345 678 901}.
Mr {n:Featherstone} disputes the invoice and wants an answer at {e:p.featherstone@brightwell.co.uk}.
Kindly forward everything to {e:incident-desk@harrowgate.org} before noon.
The leaked table listed {n:Ximena Arriaga} together with her CURP {i:ARXI900412MDFRRM08}.
{n:Dagny Sørensen} and {n:Tormod Bakke} maintain the northern mirror.
You may text {n:Kwabena Asante} on {p:+233 24 555 0134} during the night.
Someone pasted the social security number {i:219-09-9999} of {n:Lorraine Pickering} into the wiki.
Our landlord moved; letters now go to {a:7 Quayside Mews, Whitby YO21 1AB}.
Die Kollegin {n:Annegret Schlüter} sitzt seit März in {a:Talstraße 33b, 70182 Esslingen}.
Frau {n:Oberhuber} ruft morgen zurück, ihre Nummer lautet {p:+43 1 5550 1234}.
Laut Personalakte wohnt Herr {n:Wendelin Krautwurst} am Kanal; Steuer-ID {i:44 567 139 207}.
Wer den Schlüssel braucht, schreibt an {e:pforte@werk-nord.de} oder wählt {p:0351 4445566}.
{n:Hubertus Zwingmann} hat den Bericht gestern unterschrieben.
Madame {n:Vauquelin} souhaite être rappelée au {p:06 39 98 12 34} dès lundi.
La facture de {n:Thibaut Garrigue} porte l'adresse {a:8 ter impasse des Cordeliers, 84000 Avignon}.
Selon {n:Solène Kerbrat}, le correctif casse la page d'accueil.
Le passeport {i:17FV20845} appartient à M. {n:Bonnefoy}.
Le contrat fut signé par {n:Aurélien Tessandier} et {n:Maud Chastagnier}.
Don {n:Evaristo Llorente} cambió de domicilio: {a:Calle de los Alamos 19, 2º B, 37008 Zamora}.
Pregunte por {n:Itziar Goikoetxea} en el {p:+34 612 555 018}.
La ficha de {n:Macarena Olmedo} incluye el DNI {i:71934856K} y su correo {e:macarena.olmedo@cordel.es}.
Según {n:Baltasar Quesada}, la copia de seguridad falló dos veces.
Signora {n:Fiammetta Zanardi} abita in {a:Via dei Mille 41, 20129 Cremona}.
Grazie a {n:Ruggero Tamburini} per la segnalazione.
De wijziging van {n:Femke Hoogland} is gisteren samengevoegd.
Vendor contact: {n:Gwendolyn Ashdown}, {e:gashdown@pallister-group.com}, {p:0113 496 0751}
approver: {n:Tuomas Virtanen}
{{"employee": "{n:Nokuthula Dlamini}", "handset": "{p:+27 82 555 0199}"}}
{{"patient": "{n:Clementine Roth}", "insurance": "{i:QX 45 81 22 C}", "ward": "B12"}}
customer,{n:Desmond Achebe},{e:d.achebe@lumina.africa},{p:+234 803 555 0117}
4471;{n:Farrokh Irani};{a:22 Cuffe Parade, Mumbai 400005};{p:+91 98200 55512}
<b>{n:Ekow Mensah}</b> will host the retrospective.
# reviewer for this folder: {n:Zuzana Horáková} <{e:zuzana@stavba.cz}>
// originally by {n:Lachlan Drummond}, rewritten since
Signed on behalf of the board, {n:Philomena Grogan}
With kind wishes\n{n:Torquil Maclean}\n{a:31 Harbour Terrace\nOban PA34 4LJ}\nTel {p:01631 555 072}
All the best,\n{n:Bettina Grünwald}\n{p:+49 89 5550 4711}
Emergency line: {p:(604) 555-0147}, ask for {n:Harjit Dhaliwal}.
My old number was {p:555-010-4477}, please drop it from the sheet.
Dial {p:1-800-555-0136} and choose option three.
Voicemail from {p:0207 946 0018} arrived after the outage.
Faxes reach us at {p:+81 3 5550 7788} only on weekdays.
The keycard belonged to {n:Ines Dragomir}, licence {i:DRAGO809241ID9KL}.
Blank out NHS staff id and the national insurance number {i:JX 31 77 42 A} in that screenshot.
A photo of her driving licence, {i:HOLMW557119HL9}, sat in the public bucket.
That customer typed passport number {i:C4H29ZK71} into the comment box.
Redact Aadhaar {i:4820 1175 9036} on page two.
CPF {i:529.982.247-25} turned up in the access log.
The personnummer {i:811218-9876} is a documented example, yet it must go.
We shipped the replacement drive to {a:940 Kettleman Avenue, Suite 210, Lodi, CA 95240} on Tuesday.
She grew up at {a:5 Thornycroft Row, Burslem ST6 4QQ} and never left.
Meet at {a:Mühlgasse 8, 8001 Winterthur} around six.
Das Lager zieht nach {a:Am Alten Hafen 12, 27568 Cuxhaven} um.
Colis à déposer au {a:64, boulevard Carnot, 06400 Cannes} avant midi.
Nueva sede: {a:Paseo de Zorrilla 101, 47007 Palencia}.
The pharmacy on the corner, {a:1180 Dunsmuir Blvd, Kelowna, BC V1Y 6N7}, keeps a copy.
Please reply to {e:lucinda_hargreaves @ fenland.net} rather than the list.
My address for patches is {e:wes(at)tinkerbox(dot)org}.
Spam keeps arriving from {e:offers at dealnest dot biz} every night.
Team mailbox {e:platform-guild[at]orchestra.io} is monitored round the clock.
CC {e:AUDIT@NORTHGATE.GOV} on anything with customer data.
{n:J. P. Lockhart} and {n:Winnie Tsang} disagree about the severity.
{n:Halvorsen, Ragnhild} is on call this weekend.
{n:Prakash, D.} approved the exception.
The commit by {n:Casimir Wolańczyk} reverted the sanitizer.
Ask {n:Nkechi Obiora} whether the token was rotated.
Can {n:Rosheen} join the bridge at ten?
I paired with {n:Tamsin Crowther} on the taint rules, and {n:Ephraim Lindgren} took notes.
Dr. {n:Amarachi Eze} published the exploit two days early.
Professor {n:Ildikó Balogh} reviewed the threat model.
Nobody except {n:Quentin Delahaye} can unlock the vault.
Sincere thanks go out to {n:Mirela Stoica}.
They blamed {n:Roderick Pym} for the outage, wrongly.
Between us, {n:Saskia Duivenvoorde} wrote most of the parser.
Upgrade Falcon Bridge to 4.2.1 and restart the Harbor Console.
The Copper Lantern dashboard shows 481 open alerts for March.
Node 12 rejected 3041 handshakes because the cipher list was empty.
Neither Chrome nor Firefox honours the Content Security Policy here.
Ruby on Rails 7.1 and Django 4.2 both escape this by default.
See RFC 6749 section 4.1.2 and CVE-2021-44228 for background.
Order 88231-07 shipped with serial 4471-882-19 and costs EUR 1.249,00.
The gateway at 192.168.14.7 answered on port 8443 within 12 ms.
Checksum 4fe19a77c0d2 differs from the manifest of build 2024-11-03-118.
Install @babel/core@7.23.0 from registry.internal.test, then rerun.
git clone git@code.forge.test:infra/toolbox.git
Main Street is only the name of the theme, and High Road the fallback.
Sanitize the Referer header before Apache Tomcat logs it.
Der Angreifer kann über die Schnittstelle beliebige Dateien überschreiben.
Nach dem Neustart meldet der Dienst wieder 17 Treffer in core/loader.py.
Le tampon déborde lorsque la requête dépasse 4096 octets.
Hay que renovar el certificado antes del viernes y reiniciar el servicio.
Known Limitations: Windows Server 2019 and Oracle Linux 8 are untested.
Reproduced on Ubuntu 22.04, Kubernetes 1.29 and OpenSSL 3.0.13.
Access Denied (403) comes from Cloud Armor, not from Envoy Proxy.
User Story: As a Release Manager I want Signed Tags.
coordinates 48.85661, 2.35222 were logged 20240311 at 14:02:55
trace 7f3a-99821-bc and span 0045512 belong together
Buffer Overflow in Image Decoder allows Remote Code Execution.
The Quality Gate failed: Line Coverage fell to 71 percent in Payment Service.
""".strip().split("\n")


def held_out() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)])."""
    out = []
    for line in SENTENCES:
        text, spans = "", []
        for part in re.split(r"(\{[nepia]:[^{}]*\})", line.replace("\\n", "\n")):
            if m := re.fullmatch(r"\{([nepia]):([^{}]*)\}", part):
                spans.append((len(text), len(text) + len(m[2]), _KINDS[m[1]]))
                text += m[2]
            else:
                text += part.replace("{{", "{").replace("}}", "}")
        out.append((text, spans))
    return out
