"""The small labelled table from which the personal-information tagger is trained.

Carrier sentences hold slots and alternatives in square brackets; `labelled_rows` fills them by rule
with a fixed seed and gives (text, spans). The table is invented: it holds no real person, and none
of its sentences comes from a data set that the tagger is meant to read.
"""

from __future__ import annotations

import random
import re

KINDS = ("name", "email", "phone", "identity_number", "street_address")

TITLES = "Dr Dr. Mr Mr. Mrs Mrs. Ms Ms. Miss Prof. Professor Sir Herr Frau Herrn Dr.-Ing. Sr. Sra. Srta. Señor Señora Don Doña Sig. Signora Mevrouw Dhr.".split()
FRENCH_TITLES = "M. M. Mme Mme. Mlle Dr Monsieur Madame Me".split()

_GIVEN = (
    "Abigail Adaeze Adrián Aditya Agnieszka Alasdair Alberto Aleksandra Amélie Amira Andrzej Anjali Antoine Arjun Astrid Ayodele Baptiste Bartosz Benedikt Bianca Birgit Brendan Brigitte Callisto Camille Cathal "
    "Cecilia Chidi Chloé Cornelia Cristóbal Daniela Declan Deepa Dieter Dimitra Dominik Edith Eduardo Eimear Ekaterina Eleanor Elif Elliott Emeka Emilia Enrique Esra Esteban Eszter Florence Folasade Frédéric Friedrich "
    "Gabriela Gareth Geoffrey Giacomo Gisela Gonzalo Gunther Hadiza Harriet Haruto Heather Hélène Hideo Ignacio Imogen Isabel Iwona Jacques Jadwiga Jelena Jennifer Joaquín Jocelyn Johanna Jürgen Kamala Kateryna Keiko "
    "Kenji Khalid Kofi Krzysztof Lakshmi Leopold Leticia Liesel Lorenzo Ludovic Magdalena Magnus Malcolm Manuela Marguerite Mariam Marisol Mathilde Matteo Meera Mehmet Milica Mireille Mohamed Monika Nadezhda Natsuki Ngozi Nikhil "
    "Nikolai Octavia Oleksandr Ophelia Orla Ottilie Padraig Pascal Patricia Philippa Piotr Rajesh Ramón Ravi Rebecca Reinhard Rhiannon Roberto Rosalind Roxana Rupert Salma Sanjay Saoirse Sebastian Shanice Shreya Sibusiso "
    "Sigrid Silvio Sinéad Solveig Soren Stanisław Stéphane Sunita Svetlana Takeshi Tatiana Theodora Thierry Tobias Ulrich Valentina Vikram Vincent Virginia Walter Wilhelmina Winston Xiaoling Yevgeny Yolanda Youssef Zbigniew Zsófia"
).split()
_KNOWN_GIVEN = (
    "James John Michael William Richard Joseph Charles Daniel Matthew Anthony Steven Andrew Kenneth Joshua Kevin Brian George Edward Ronald Timothy Jason Jeffrey Jacob Nicholas Eric Jonathan Stephen Justin Scott Brandon Benjamin Gregory Patrick Alexander Jack Dennis Mary Linda Barbara Susan "
    "Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Stephanie Sharon Amy Angela Emma Pamela Nicole Helen Christine Ahmed Ali Hassan Ivan Marco Mario Antonio Francisco Jorge Fernando Sergio Klaus Hans Wolfgang Michel Philippe Adam Simon Martin Paul Thompson Diego Jesse Kate Lucy Nathan Oliver Ryan Tom Wang Li Chen Kim Park Singh Khan"
).split()
_PLAIN_GIVEN = "Rose Faith Hope Will Mark Bill Iris Hazel Ivy Dawn June April May Frank Grant Miles Rich Art Gene Joy Summer Autumn Pearl Ruby Reed Chase Drew Jean Rob Pat Sue Ray".split()
_LAST = (
    "Abernathy Achterberg Adeyemi Aguilar Almeida Andersen Andrade Baumgartner Beaumont Bergström Bhattacharya Bianchi Blanchard Bogdanov Botha Bouchard Brandt Brzeziński Cabrera Calloway Castellanos Cavendish Chukwu "
    "Cieślak Conti Cunningham Dąbrowski Delacroix Desmoulins Diallo Dubois Dumitrescu Eriksson Espinoza Estévez Falkenberg Faulkner Ferrari Figueroa Fitzgerald Fontaine Friedmann Fukuda Gallagher Gauthier Ghosh Goldstein "
    "Grabowski Gutiérrez Haugen Hendricks Hernández Hirano Hoffmann Horváth Hussain Ibáñez Ivanova Iyer Jankowski Jiménez Johansson Kapoor Karlsson Kaufmann Kawasaki Keller Kimani Kowalczyk Krishnan Kuznetsov Lachance "
    "Lefèvre Lindqvist Lombardi Mahmoud Malinowski Mancini Marchetti Mbeki McAllister McKenna Mehta Meyerhoff Moreau Morrison Mukherjee Müller Nakamura Ndlovu Nguyen Novák Nwosu Obermeier Odhiambo Okonkwo Olufemi Ortega "
    "Osei Papadopoulos Patel Pellegrini Petrov Pfeiffer Popescu Quigg Ramaswamy Reinholt Ricci Rodríguez Rosenthal Rousseau Sakamoto Sandoval Schneider Serrano Shevchenko Sithole Söderberg Sokolov Stavridis Steiner Szabó "
    "Takahashi Tanaka Thibault Thompson Toussaint Tremblay Ueda Vandenberg Vasquez Venkataraman Villanueva Vogel Wagner Weatherby Wesołowska Whitcombe Wiśniewska Wójcik Yamamoto Zapata Zawadzki Zimmermann"
).split()
_PLAIN_LAST = "Brown Young King Hill Wood Fisher Baker Cook Rivers Banks Price Long Day Carter Miller Hunter Mason Porter Turner Walker Ward Woods Page Parks Stone Swift Sharp Small Bishop Marsh Berry Cross Field Knight Lamb Nash Pool Rice Wells West".split()
_STARTS = "Ab Al An Ar Bal Bar Bel Bo Bri Cal Cam Car Cas Chi Co Da Del Do Du El Es Fa Fe Fi Fo Ga Ge Gi Go Gra Ha He Hi Ho Ib Is Ja Je Jo Ka Ke Ki Kle Ko Kra La Le Li Lo Lu Ma Me Mi Mo Mu Na Ne Ni No Ob Ol Or Pa Pe Pi Po Pra Ra Re Ri Ro Ru Sa Sche Se Si Ste Ta Te Thor Ti To Tre Ul Va Ve Vi Vo Wa We Wi Ya Yo Za Ze Zu".split()
_MIDDLES = "ba be bi da de di do ga ge go ka ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi za".split()
_ENDS = "ack ado aert age ain ak ald aldi ano ant ard ares asse aud auer beck berg bert born by cott cz d dale do dt eau eck eira elli en enko ente er ert es et eu feld ford fried g gard gren grin guez haus hout i ian ides iel iez igan ik ina ing ini ino ioli ish ison itz kamp ke la lan le lein li lin litz lund man mans mark mer mond more n nak nen ner ng nik o off ola om on oni opo os ot oux ov ova r ra ram ran rell res ri ric ro rt ru s sch se sey shi smith son stad stein t ta ton tt u uchi ue ulos um ura us vall vic vich voort witz y yan z zer zon".split()
_TOWNS = (
    "Aberdeen Albuquerque Amersfoort Antwerp Aarhus Bamberg Bangalore Bayonne Bergamo Birmingham Bloomington Bologna Bordeaux Boulder Braga Bremen Brisbane Bristol Buffalo Burgos Calgary Cambridge Cardiff Charleston Chennai Coimbra Cork "
    "Darmstadt Delft Dijon Dortmund Dresden Durban Durham Edinburgh Eindhoven Essen Exeter Freiburg Fresno Galway Genoa Ghent Girona Glasgow Grenoble Göttingen Halifax Hamburg Heidelberg Hyderabad Innsbruck Jaipur Kiel Kilkenny Konstanz Lausanne Leicester "
    "León Lille Limerick Linz Liverpool Lübeck Lyon Madison Mainz Málaga Mannheim Melbourne Memphis Milano Montpellier Mumbai Murcia Nantes Napoli Norwich Nottingham Nürnberg Omaha Ottawa Oviedo Oxford Padova Pamplona Perth Phoenix Pittsburgh Portland Potsdam "
    "Preston Providence Pune Reims Rennes Richmond Rotterdam Rouen Sacramento Salamanca Salzburg Savannah Seattle Segovia Seville Sheffield Southampton Spokane Stuttgart Swansea Sydney Tampa Toledo Torino Toronto Toulouse Trier Tucson Utrecht Valencia Vancouver Verona Weimar Wexford Winnipeg Worcester York Zaragoza Zürich"
).split()
_TWO_WORD_TOWNS = ("New Haven", "Santa Fe", "Palo Alto", "Mountain View", "San Diego", "St. Gallen", "Bad Homburg", "Fort Worth", "Grand Rapids", "Las Palmas", "Le Havre", "Salt Lake City", "La Rochelle", "Saint-Denis", "Aix-en-Provence", "Newcastle upon Tyne", "Frankfurt am Main", "Redwood City", "King's Lynn")
_TOWN_ENDS = "ham ton ley by worth minster chester pool mouth dale hausen heim burg bach au furt weiler court ac y illac ano ino eda era illa stead combe wick thorpe stow hurst fell gate haven mere".split()
_ROAD_WORDS = (
    "Acacia Ash Baker Bank Birch Bishop Canal Castle Cedar Cherry Clarence Coach Cumberland Dean Dover Duke Elm Fountain Garden George Hawthorn Hazel Highfield Hillside Holly Jubilee King Laurel Lincoln London Long Maple Market New North Palace Pine Poplar "
    "Prince Princess Priory Regent River Rosemary Russell School Sycamore Thornton Trinity Union Valley Vicarage Washington Waterloo West Windsor Woodland York Franklin Jefferson Madison Cortland Amstel Lombard Mission Bergen"
).split()
_ROAD_KINDS = "Street Street Road Road Avenue Avenue Lane Drive Close Court Crescent Gardens Grove Place Square Terrace Way Walk Row Mews Parade Parkway Boulevard Circle Trail Highway St St. Rd Rd. Ave Ave. Blvd Blvd. Dr. Ln Ct Pkwy Hill Park Green".split()
_DE_ROADS = "Linden Bahnhof Haupt Garten Schiller Goethe Kirch Schul Rosen Berg Wald Wiesen Mozart Ring Birken Eichen Kastanien Ulmen Brunnen Markt Post Rathaus Fischer Weber Müller Ludwig Wilhelm Burg See Ufer".split()
_DE_KINDS = "straße straße straße strasse str. weg weg gasse allee platz ring ufer damm steig".split()
_STATES = "AL AK AZ CA CO CT DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MT NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY".split()
_HOSTS = "acorn alder anchor apex atlas birchwood bluefin cedarhill cobalt delta drift elmtree everest fern foxglove garnet hemlock hillcrest iron jade kelp lark linden lotus maple nimbus northwind oakleaf opal palm pine prairie quill redwood ridge river sage sequoia slate summit sunrise tidal umber valley vista wave willowbrook zephyr".split()
_HOST_ENDS = ("", "", "", "", "-labs", "-it", "soft", "net", "tech", "-group", "systems", "-data", "hosting", "mail")
_DOMAINS = "com com org net io dev de fr es it nl edu co.uk co.in com.au gov info eu example test invalid".split()
_BOXES = "security abuse info support help hello contact admin webmaster office billing privacy press jobs noreply postmaster disclosure cert soc oncall triage maintainers team release-team bugs sales hr".split()

#: Sentences with personal information. {t} is a title, {m} a French one; [a|b] is one of a and b, and {g} is a word that isn't personal.
CARRIERS = """
[Found|Spotted|Raised|Logged|Filed|Noticed] by {name}[.| on {date}.| last week.|, who also sent a patch.| during the audit.]
[Found|Spotted|Raised|Logged|Filed|Sent in] by {t} {last}[.| on {date}.| last week.]
{name} [opened|closed|filed|reopened|approved|merged|triaged|rejected|tested|wrote|asked|answered|noticed|found|fixed|reported|said|agreed] [this|it|the ticket|the change|a test|that it fails|the second part].
{name} [writes|wrote|commented|replied|added|asks|answers|noted|insists]: [please|can you|why|it|that|no|the log|does this|I] [fails|works|wait|is fine|close|merge it|see line {n}]
{first} [writes|wrote|replied|added|asks]: [please|can you|why|it|no] [wait|is fine|merge it|see line {n}]
[Ask|Poke|Wake|Warn|Try|Include|Invite] {name} or {name} [once|when|if|before|after|in case] [it|the job|the build|the run] [passes|stalls|ends|is done].
[Ask|Poke|Wake|Warn|Try|Include|Invite] {name} [once|when|if|before|after] [it|the job|the build|the run] [passes|stalls|ends].
{name} [and|or|plus|with] {name} [will|can|should|must] [look|decide|sign off|take over].
[Only|Even|Also|Except|Perhaps|Luckily|Meanwhile|Apparently,|Later|Then] {name} [knew|saw|complained|noticed|has access|was paged].
[It|This|That] was [first|later|also] [seen|found|shown|raised|fixed] by {name}[.|, then by {name}.| in {y}.]
[The|A|Another] [comment|patch|mail|commit|review|question|idea|branch] [by|from|of] {name} [is|was|got] [late|lost|merged|ignored].
{name} [says|thinks|believes|suggests|argues] [that|] the [patch|test|report|change] is [fine|wrong|late|good].
{first} [says|thinks|mentioned|told us|asked] that the [patch|test|report] is [fine|wrong|late].
[Please|Could you] [ask|ping|call|tell|thank|invite|notify] {name} [about it|before Friday|first|if it breaks again].
[Please|Could you] [ask|ping|call|tell|thank|invite|notify] {first} [about it|before Friday|first|if it breaks again].
[Assigned|Handed over|Escalated|Forwarded|Reassigned] to {name}[.|, {phone}.| ({email}).|; call {phone}.| for a second look.]
[Assigned|Handed over|Escalated|Forwarded] from {name} to {name}[.| on {date}.]
[Moved|Passed] from {name} to the [backend|release|night] [group|shift], [phone|reach them on|ring] {phone}.
[Moved|Passed] from {t} {last} to the [backend|release|night] [group|shift], [phone|reach them on|ring] {phone}.
[Written|Drafted|Prepared|Designed|Proposed] by {name}, [checked|reviewed|approved|tested] by {name}.
The [change|note|script|rule] was [written|prepared|proposed|tested] by {name} and [checked|read|approved|merged] by {name}.
[Thanks|Many thanks|Kudos|Hat tip|Props] to {name} [for|and {name} for] [the ticket|finding this|the fix|reviewing].
[Credit|Credits|Acknowledgements]: {name} ({email}), {name}
[Credit|Thanks] [is due|belongs] to {name} ({email})[.| who found it.]
[Credit|Thanks] [is due|belongs] to {t} {last} ({email})[.| who found it.]
[In the words of|As stated by|As told by|Quoting] {name}, the [exploit|demo|sample] [runs|fails|needs root].
[In the words of|As stated by|As told by|Quoting] {t} {last}, the [exploit|demo|sample] [runs|fails|needs root].
[Speak|Talk] [to|with] {t} {name} [or|and] {t} {last}.
{t} {name} [signed|accepted|called about|explained|repeated] it [on {date}|in a call ({phone})|by mail ({email})|over the line ({phone})].
{t} {last} [signed|accepted|called about|explained|repeated] it [on {date}|in a call ({phone})|by mail ({email})|over the line ({phone})].
{t} {last} [wants|prefers|requests] [answers|mail|replies] [to|at] {email}[.| only.| from now on.]
[The patient|Patient|The applicant|Candidate|Employee|Customer|The tenant|Witness|Student] {name}[,|] [born on {date}|was seen on {date}|has {id}|lives at {address}][.|; see file {n}.]
[The patient|The applicant|Our customer|The holder] is {name}, {id}[.|, {address}.]
[The login|That mailbox|This profile|The stolen card] [is owned by|is that of|was issued to|is registered to] {name}, {id}, [so|and] [it is blocked|please lock it].
[We|I] [saw|met|visited|spoke with] {name} [at|after] the [fair|summit|meetup|training]; [their|the] [card|lanyard|form] [read|carried|had] {id}.
[Record|Entry|Line|Sample] {n} [has|shows|contains|still has|leaks] {id}[.| in plain sight.| and must be wiped.| for everyone to read.]
[The dump|A debug log|The backup|This fixture|The export] [has|shows|contains|leaks] {id} [of|for|belonging to] {name}.
[The dump|A debug log|The backup|This fixture|The export] [names|has|shows] {name} [of|from|at] {address} [and|plus|along with] {id}.
[Remove|Delete|Erase|Mask|Blank] {id} [before|from] [the release|the seed data|publishing].
[Verify|Check|Confirm] {id} [against|with] the [register|form].
{id}
ID: {number}
{name} ({id})
Name: {name}[, |; | / |\\n]DOB: {date}[, |; | / |\\n]{id}
Name: {name}\\nAddress: {address}\\nPhone: {phone}\\nE-mail: {email}
Full name: {name}\\nStreet: {address}\\nMobile: {phone}
name: {name}\\n[tel|phone|mobile]: {phone}\\n[mail|email]: {email}\\naddress: {address}
[Bill|Ship|Deliver|Post|Send|Return] [to|it to]: {name}[, |\\n]{address}
[Ship|Deliver|Post|Send|Return] the [parcel|laptop|keys|badge|box|router] to {address}[.| please.|, third door.]
[Our|The] [new|old|main] [office|workshop|lab|depot] is at {address}[.| since {date}.| until further notice.]
[She|He|They] [moved|relocated] to {address}[.|; fix the directory.|, so change the records.]
{name} [moved|relocated] to {address}[.|; fix the directory.|, so change the records.]
[Spare parts|Discs|Smart cards|Forms|Letters|Deliveries] [are sent|should be sent|can be posted] to {address}.
{name} [lives|resides|works] at {address} [and|but] [answers|picks up|is reachable under] {phone}.
[Ring|Dial|Phone|Try] {phone} [if|when|after] [nobody answers|the alarm goes off|it hangs|the link is down|{n} minutes].
[Hotline|Phone|Tel|Tel.|Fax|Mobile|Cell|Office|Desk|Telephone|Direct line][:| ]{phone}
[Ph|T|M|F]: {phone}
[My|Our|The] [number|mobile|line|fax] [is|changed to] {phone}[.|, ask for {name}.|, ask for {first}.]
[Text|SMS|WhatsApp|Signal] {phone} [or|and] [mail|write] {email}[.|]
[Mail|Write|Send mail|Send it|Report] to {email} [first|today|if in doubt|until {date}|and wait].
[Questions|Complaints|Details] [go|should go|please] to {email}[.|]
[Reach|Find] us [at|under] {email} or {phone}.
[You can|One may] [reach|find] {name} [at|under|via] {email}[.|, {phone}.]
[To|Bcc|Reply-To|Sender|Mail|E-mail|Contact]: {email}[|, {email}|; {email}]
[copy|cc|to] {email}[, | and |; ]{email}[|.]
{email}
mailto:{email}
[From|To|Cc|Author|Committer]: {name} <{email}>
[Acked-by|Tested-by|Helped-by|Suggested-by|Reviewed-by|Approved-by]: {name} <{email}>
@author {name} <{email}>
@author {name}
Copyright (c) {y} {name} <{email}>
Copyright {y} {name}. All rights reserved.
maintainer = "{name} <{email}>"
authors = ["{name} <{email}>", "{name} <{email}>"]
[#|//|--] [NOTE|HACK|XXX|todo]({name}): [drop this|rename|wrong unit|too slow]
[#|//|--] [NOTE|HACK|XXX|todo]({name}): [drop|hide|mask] {id} [here|in the sample|later]
[#|//|*] [ask|see|owner:|by] {name}[, |: ]{phone}
{{"name": "{name}", "tel": "{phone}"}}
{{"user": "{name}", "email": "{email}", "cell": "{phone}"}}
{{"owner": "{name}", "mobile": "{phone}", "contact": "{email}"}}
{{"fullName": "{name}", "ssn": "{number}", "street": "{address}"}}
{{"id": {n}, "person": "{name}", "document": "{number}", "home": "{address}"}}
{{"first": "{first}", "last": "{last}", "passport": "{number}"}}
<person><name>{name}</name><tel>{phone}</tel><mail>{email}</mail></person>
<tr><td>{name}</td><td>{number}</td><td>{phone}</td></tr>
<li>{name}, {address}</li>
<address>{address}</address>
[Dump|Row|Record|Seed|Sample line|csv]: {name};{number};{address};{phone}
[Dump|Row|Record|Seed|Sample line|csv]: {name};{number};{phone};{email}
{name};{number};{address};{phone}
{name},{number},{email}
{name}|{number}|{address}|{email}
{n};{name};{phone};{email}
{n},{name},{number},{phone}
{name}\\t{phone}\\t{address}
| {name} | {email} | {phone} |
| {name} | {number} | {address} |
INSERT INTO people VALUES ({n}, '{name}', '{number}', '{address}');
INSERT INTO contacts (name, phone) VALUES ('{name}', '{phone}');
BEGIN:VCARD\\nFN:{name}\\nTEL:{phone}\\nEMAIL:{email}\\nEND:VCARD
[Duty|Night shift|Pager|Backup|Standby|Escalation|Contact person]: {name}, {phone}
[Duty|Night shift|Pager|Backup|Standby|Escalation|Contact person]: {name} / {email} / {phone}
[Attendees|Present|Reviewers|Members|Speakers]: {name}, {name}, {name}
[Attendees|Present|Reviewers|Members|Speakers]: {name}; {name}
- {name}
- {name}: {phone}
* {name}, {email}
1. {name} - {address}
[Regards|Cheers|Best|Sincerely|Yours truly|Thanks|Best regards|Many thanks|Warm regards],\\n{name}
[Regards|Cheers|Best|Sincerely|Yours truly|Thanks|Best regards|Many thanks|Warm regards],\\n{name}\\n{address}\\n[Phone|Tel|Tel.|Mobile]: {phone}
[Regards|Cheers|Best|Sincerely|Yours truly|Thanks|Best regards|Many thanks|Warm regards],\\n{name}\\n{address}\\n[Phone|Tel|Tel.|Mobile] {phone}
[Regards|Cheers|Best|Sincerely|Best regards|Warm regards],\\n{name}\\n[Phone|Tel|Tel.|Mobile]: {phone}\\n{email}
[Dear|Hi|Hello] {name},
[Dear|Hello] {t} {last},
[Hi|Hello|Hey] {first}, [the scan is done|can you look|thanks].
[Both|Neither] {name} [and|nor] {name} [replied|objected|can reproduce it].
{name}'s [laptop|account|patch|branch|badge] [was|is] [lost|locked|stale|fine].
[Interview|Call|Meeting] with {name} [on {date}|at noon|about the outage][.|; passcode {n}.]
[According to the register,|Today|Since {date}] {name} [holds|has|uses] {id}[.| and {id}.]
[Her|His|Their] [new|private|work] [number|mobile] is {phone}, [her|his|their] [mail|address] {email}.
[Gefunden|Eingereicht|Erfasst|Notiert|Bearbeitet|Geprüft] von {name}[.|, Telefon {phone}.|, {email}.| am {date}.|, zu erreichen unter {phone}.]
{t} {last} [hat|will|kann] [das Ticket|den Fall|die Meldung] [geprüft|geschlossen|weitergeleitet][.| und bittet um Rückruf: {phone}.]
{t} {last} [schreibt|kommt|bittet|fragt|sagt|meint|antwortet] [heute|später|erneut|um zehn|aus dem Büro][.|, Durchwahl {phone}.|, dass es eilt.]
{m} {last} [demande|attend|écrit|viendra|propose|refuse|accepte] [une réponse|le rapport|ce matin|la suite][.| avant midi.|, poste {phone}.]
{t} {last} [pide|espera|escribe|vendrá|propone|acepta] [una respuesta|el informe|mañana][.| antes del lunes.|, teléfono {phone}.]
{t} {last} [left|arrived|resigned|signed|called|objected|owns it|runs the lab] [today|early|last week|at noon|again][.|, extension {n}.]
[Rückfragen|Fragen|Hinweise] bitte an {name} ({email})[.| richten.]
[Zuständig|Verantwortlich|Betreuerin|Betreuer|Vertretung] [ist|war|bleibt] {t} {last} ({email}).
[Zuständig|Verantwortlich|Betreuerin|Betreuer|Vertretung] [ist|war|bleibt] {name}, {email}.
[In der Datei|Im Export|In der Sicherung|In Zeile {n}|Im Protokoll] [findet sich|erscheint|liegt] {name} mit {id}.
[In der Datei|Im Export|In der Sicherung|In Zeile {n}|Im Protokoll] [findet sich|erscheint|liegt] {id} von {t} {last}.
[Das Paket|Die Karten|Der Brief|Ersatzteile] [geht|gehen|ging] an {address}[.| und nicht ins Büro.]
[Pakete|Briefe|Geräte] an {address} [senden|liefern|richten|zurückgeben].
[Anschrift|Wohnhaft|Adresse|Lieferadresse]: {address}
[Mit freundlichen Grüßen|Viele Grüße|Beste Grüße|Herzlich]\\n{name}\\n{address}\\n[Tel.|Telefon|Mobil:] {phone}
[Trouvé|Transmis|Relevé|Corrigé|Validé] par {name}[.| ({email}).|, joignable au {phone}.]
[Trouvé|Transmis|Relevé|Corrigé|Validé] par {m} {last}[.| ({email}).| au {phone}.]
[Veuillez|Il faut] [rappeler|contacter|prévenir|joindre] {name} au {phone}.
[Veuillez|Il faut] [rappeler|contacter|prévenir|joindre] {m} {last} au {phone}.
[Le fichier|La sauvegarde|L'export|La ligne {n}] [montre|expose|contient|garde] {id} de {m} {last}.
[Le fichier|La sauvegarde|L'export|La ligne {n}] [montre|expose|contient|garde] {id} de {name}.
[La lettre|Le matériel|Le badge|Le courrier] [est envoyé|part|doit partir] [à|au|chez] {address}.
[Cordialement|Bien à vous|Salutations],\\n{name}\\n{address}\\n[Tél.|Tél. :|Portable :] {phone}
[Écrire|Écrivez] à {email} ou [appeler|téléphoner] au {phone}.
[Encontrado|Enviado|Comunicado|Revisado|Detectado] por {name}[.|, vecino de {address}.|, con residencia en {address}.| ({email}).]
[Encontrado|Enviado|Comunicado|Revisado|Detectado] por {t} {last}[.|, {phone}.| ({email}).]
[Escribir|Mande un correo|Envíe un aviso] a {email} [o marcar el|o al] {phone}.
[El archivo|La copia|El volcado|La fila {n}] [muestra|contiene|expone|guarda] {id} de {name}.
[El archivo|La copia|El volcado|La fila {n}] [muestra|contiene|expone|guarda] {id} de {t} {last}.
[El paquete|La carta|El equipo] [va|llega|se manda] a {address}.
[Saludos|Un saludo|Atentamente],\\n{name}\\n{address}\\n[Tfno.|Tel.|Móvil:] {phone}
[Vu|Lu|Fait|Écrit|Ouvert|Fermé|Noté|Rédigé] par {name}[.| le {date}.| ({email}).| et {name}.|, puis par {name}.]
[Appelez|Prévenez|Remerciez|Invitez] {name}[.| au {phone}.| avant midi.| ou {name}.]
[Le dossier|La fiche|Le compte|La demande] de {name} [est clos|est ouvert|porte {id}|mentionne {address}].
{name} [a|avait] [ouvert|fermé|relu|écrit] [le ticket|la note|ce rapport].
[Visto|Leído|Hecho|Escrito|Abierto|Cerrado|Firmado] por {name}[.| el {date}.| ({email}).| y {name}.|, luego por {name}.]
[Llame|Avise|Invite|Pregunte] a {name}[.| al {phone}.| hoy mismo.| o a {name}.]
[La cuenta|El caso|La ficha|El contrato] de {name} [sigue abierta|está cerrado|incluye {id}|indica {address}].
{name} [ha|había] [abierto|cerrado|escrito|firmado] [el caso|la nota|este informe].
[Die Akte|Das Konto|Der Antrag|Die Mail] von {name} [ist offen|bleibt zu|nennt {id}|nennt {address}].
{name} [hat|hatte] [den Fall|die Notiz|diesen Bericht] [geöffnet|geschlossen|gelesen].
[Frag|Ruf|Informiere|Bitte] {name}[.| unter {phone}.| noch heute.| oder {name}.]
[Der Kollege|Die Nachbarin|Der Kunde|Unsere Chefin] {name} [ist|war|bleibt] [im Urlaub|am Telefon|zuständig].
[The|A] [list|sheet|table|page|mail] [names|shows|includes|mentions|lists|has] {name} [of|from|at|in|near] {address}[.| with {id}.]
[The|A] [list|sheet|table|page|mail] [names|shows|includes|mentions|lists|has] {name}[.| with {id}.|, {phone}.]
[Segnalato|Inviato] da {name} ({email})[.|, tel. {phone}.]
[Gemeld|Gevonden] door {name}, [telefoon|mobiel] {phone}[.|]
[Enviado|Relatado] por {name}, {id}[.|, {address}.]
""".strip().split("\n")

#: Sentences without any. {p} a product, {w} a word, {f} a function, {n} a number, {v} a version, {path} a path, {st} a street-like name.
NEGATIVES = """
[The|Our] {p} [team|release|docs|site] [uses|picked|shows] {st} as a [code name|theme|label][.|, see {v}.]
[The|A] [check|ping|request|reply|packet] [to|from|via] {ip}[:{n}|] [took|needed|lasted|came] [{n} ms|on port {n}|late|after {n} ms][.| on port {n}.]
[Host|Node|Route|Listen|Bind|Deny|Allow|Peer|From|Server] {ip}[/24|:{n}| {n}|,| on port {n}| is down| and {ip}]
[The|A] [value|bound|threshold] is {n}.{n}.{n} [and|or] the [window|span|interval] {n}-{n}.
[Job|Run|Artifact] {y}-0{d2}-{n}-{n} [supersedes|follows] [id|item|lot] {n}-{n}-{n}.
[Crate|Pallet|Voucher|Device|Unit|Batch] [{n}-{k}-{n}|{k}-{k}-{n}|{d6}-{k}|{d5}-{k}-{k}] [was|is] [swapped|scrapped|billed|stored][.| with {n}-{k}-{n}.| for {d6}-{k}.]
[Booked|Stored|Billed|Filed|Kept] [under|for|as] [lot|order|bill|case|unit] [{d6}-{k}|{n}-{k}-{n}|{d5}-{k}][.|; {d6}-{k} is void.]
[Hash|Digest|Fingerprint] [5e{n}c{n}f{n}|b2{n}d{n}ea] [matches|belongs to] [order|receipt|bill] {d5}-{d2}.
[Order|Receipt|Bill|Article|Part|Lot|Parcel] [no.|number|] {d6}-{d2} [was|is] [paid|late|void].
[Dump|Stack]: [address|pointer] 0x{n}a{n}c0[, frame {n}|].
[Put|Use|Add] [@Inject|@Test|@Deprecated|@staticmethod] [above|over] {f}[.| in {path}.]
git clone [git|deploy|svc]@[git.{w}.example|host.{w}.test]:{w}/{w}.git
[Fetch|Pull|Mirror] https://[bot|ci|deploy|git]@[src|git|hub].{w}.example/{w}/{w}.git [at|for] {v}.
[npm i|yarn add|pnpm add] @{w}/{w}@{v}
[Lock|Freeze|Require] pkg:[npm|pypi|maven]/%40{w}/{w}@{v} [or|and] {w}@{v}.
ssh://[git|svn]@[vcs|repo].{w}.test/{w}/{w}.git
svn+ssh://{w}@src.{w}.test/trunk
[Log in|Connect] as [root|admin|git]@[node{n}|db{n}] [and|then] run {f}.
[Update|Move|Switch|Upgrade] to {p} {v}[.| or later.| as soon as possible.]
[Updates|Bumps|Raises] {p} [from {v} to {v}|to {v}][.| and drops the fork.]
- [Bumped|Updated|Dropped|Replaced] {p} [to|at|since] {v}[.|, breaking.]
- {w} {w}: [no longer|now] [crashes|hangs] [if|once] the {w} is [missing|empty|huge] ({v}).
- [New|Added|Extra] [rule|check|guard] for {w} {w} [in|at] {path}.
- [Renamed|Retired|Removed] {f}[, call {f} instead|] [in|as of] {v}.
[#|##|###] [Known issues|What changed|Next steps|Open questions|How to test|Impact|Fixed Bugs|Release Notes|Breaking Changes]
[#|##|###] {T} {w}
[#|##|###] {p} {v}
{T} {T}
{T} {T}: {w} {w}
{p}
{p} {v} ({y}-0{d2}-11)
[Known Issues|Release Notes|Security Advisory|Quick Start|Risk Rating|Root Cause|Lessons Learned|Action Items|Due Date|Last Updated]: [none|{v}|{n}|see {path}]
[Monday|Tuesday|Wednesday|Thursday|Friday|January|March|October] [is|was] [quiet|busy], [nothing|little] [broke|changed] in {p}.
[On|By|Until] [Monday|Friday|1 March|the 4th of May], {p} [ships|stops|restarts].
[The|A|This|Each] {w} {w} [of|in|behind] {p} [may|can|must|will|does not] {w} [the|any|every] {w}[.| on {n} nodes.| before {v}.]
[The|A|This] [bug|flaw|defect|hole|issue] in {p} [up to|through|prior to] {v} [allows|permits|enables] [an outsider|any caller|a guest] [to read|to alter|to drop] {w} {w}[.| via {f}.]
[Anyone|Users|Admins|Sites|Hosts] [who|that] [run|keep|host] {p} [should|ought to] {w} [their|the] {w}.
[The|A] [rating|score|level] is [low|high|moderate] [as|since] {f} [is|was] [guarded|private|reachable].
[Fixes|Patches] [exist|are out] for {v}, {v} and {v}.
[As a stopgap|For now|Meanwhile], {w} the {w} [on|in] {p}.
[It|This|That] [fails|breaks|works|passes|stalls] [on|with|under] [Linux|Windows|macOS|Docker|Debian|Ubuntu|Alpine|Kubernetes|Java {n}|Python {v}|Go {v}|Node {n}|PostgreSQL {n}][.| only.]
[Linux|Windows|Docker|Debian|GitHub|Jenkins|Terraform|Apache Kafka|Amazon Linux|Red Hat|Visual Studio|Google Cloud|Ruby on Rails|Spring Boot|Internet Explorer] [users|builds|images|hosts] are [fine|affected|slow].
[The|Our] [Open Source|World Wide Web|Common Vulnerability|Content Security|Transport Layer] [group|model|policy|stack] [covers|lists] {n} {w} {w}.
{path}:{n}: {w} {w} [in|near|before] {f} ([low|high|info|warning])
{path}:{n}:{n} error[:| -] {w} {w}
[Scan|Report|Totals]: {n} [hits|alerts|rows], {n} [new|old|muted], {n} [errors|skips]
[Found|Saw|Counted] {n} {w} {w} in {path}[, {n} of them severe|].
[Checked|Measured] [to|with|against] {y}, {n} [are|were] [new|gone].
[Rule|Check|Policy] {w}-{w} [fired|matched] {n} [times|x][, mostly in {path}|].
[Why|How|When|Where|Which|What] [does|did|would|should] {f} [skip|keep|call|trust|drop] the {w} {w}[?| here?]
[Who|Whoever] [owns|calls|wrote] {f} [must|should] [know|say] why {n} {w} [leak|stall].
[I|We|You|They] [get|keep|lost|dropped|noticed] [one|another|a] {w} {w} [at|on|after] line {n}[.| of {path}.]
[I|We] [tried|tested|checked|ran] {p} {v} [and|but] [nothing|only {f}] changed.
[Nit|Minor|Question|Note|Hint|Tip|Warning|Todo]: {f} [and|or] {f} [overlap|clash|could share code].
[Please|Let us|Do not] {w} [the|this|any] {w} [until|unless|while] {w} {w} [is|are] [done|ready|green].
[Nice|Great|Good|Bad] [find|idea|point]; line {n} [needs|has] [a|one] {w} {w}.
[Yes|No|Maybe|Perhaps|Agreed|Done|Sorry|Right], [it|that|this] [does|is|was].
[Stop|Start|Restart|Drain|Scale|Roll back] the {w} {w}, [then|and] {w} {n} {w}.
[If|When|Once|Unless|After|Before] [the|a] {w} [drops|grows|fails|stops] [below|above|past] {n}, {w} [it|the {w}].
[Every|Each] {n} [hours|days|weeks] the {w} [is|gets] [rotated|trimmed|flushed].
[Wait|Allow|Expect] {n} [to|-] {n} [seconds|minutes|rounds][.| per {w}.]
[Alert|Wake|Notify] the [owner|team|shift] of {w}[-{w}|] [if|when] {n} {w} [fail|drop].
[Step|Stage|Phase|Round|Level|Node|Guard|Case] {n} [keeps|frees|waits for|counts] {n} {w}[.|; the rest is {w}.]
[Which|What] [smallest|first] {w} [makes|lets] {f} [fail|stop|loop][?|, and why?]
[Answer|Reply|Explain|Decide] [with|in] [a word|one line|two sentences|a number].
[NO|THE|EVERY|ANY|EACH] {W} {W} [ABOVE|UNDER|AFTER] {n} [LOSES|DOUBLES|FREES] {n} {W}.
[No|The|Every|Any|Each] {T} {T} [Above|Under|After] {n} [Loses|Doubles|Frees] {n} {T}.
def {f}({w}, {w}=None, limit={n}):
class {T}{T}({T}{T}):
import {w}.{w}.{f}
from {w}.{w} import {T}{T}
[const|let|var] {w} = require("{w}/{w}");
for (int i = 0; i < {n}; i++) {{ {w} += {f}(i); }}
if ({w} == null || {w}.{w} > {n}) return {f}({w});
func ({w} *{T}{T}) {f}({w} string) error {{
    return {w}.{f}({w}, {w}[{n}:{n}])
    raise {T}Error("{w} {w}: %s" % {w})
    logger.info("{w} {w} took %d ms", {n})
    assert {f}({w}) == {n}, "{w} {w}"
    self.{w}_{w} = {w}.get("{w}", {n})
SELECT {w}, count(*) FROM {w}_{w} WHERE {w} > {n} GROUP BY {w};
[#|//] {w} {w}: [keep|do not touch|see {path}]
{w}: {n}
  {w}_{w}: [true|false|{n}|"{v}"]
export {W}_{W}={n}
[Set|Export|Unset] {W}_{W}[={n}|] [first|again].
[See|cf.|Related:|Refs] [CVE-{y}-{d5}|CWE-{n}|RFC {n}{d2}|ISO {d5}-1|PR #{n}|issue #{n}|GHSA-5q2m-7c9x-3f8r][.|, section {n}.{n}.]
[CVE-{y}-{d5}|CVE-{y}-{n}{d2}] [affects|hits|concerns] {p} [before|up to] {v}.
[Version|Build|Tag|Revision|Commit] {v}[-rc{n}|] [came out|landed] on {y}-0{d2}-1{n}.
{y}-0{d2}-11T10:{d2}:{d2}Z [INFO|WARN|ERROR] {w}.{w}: {w} {w} ({n} ms)
[{y}-0{d2}-11 10:{d2}] {w}[{n}]: {w} {w}
[Trace|Span|Request] [{d6}-{d5}-{w}|{d6}{d6}|c1d2{d6}ef]: {w} {w}
[Amount|Sum|Balance]: [EUR|USD|GBP] {n}.{n},{d2}
[Coordinates|Grid]: {n}.{d5}, -{n}.{d5}
[Tel|Phone|Address|E-mail|Name] [field|column|label] [is|was] [blank|hidden|optional] in {p}.
[The|A] [phone|mail|street|name|passport] [field|form|check|pattern] [needs|lacks] a {w} {w}.
[Street|Road|Avenue] names are [not|never] [parsed|kept] by {p}.
[Call|Invoke|Wrap|Mock|Patch] {f} [from|before|after] {f}[.|, never twice.]
[Mail|Send|Post|Forward] the {w} to {w} [after|every] {n} [days|runs].
[Today|Yesterday|Tomorrow|Lately|Since {v}|Last year] {p} [had|has|saw] {n} {w} [more|less].
[Users|Owners|Fans|Copies|Forks|Builds|Packages|Nightlies|Authors] of {p} [want|intend|hope|try|need] to {w} [it|the {w}].
[I|We|They] [run|use|hold|keep|froze|deploy|replaced|removed|like] {p} [on|at|with|for|since|after|against] {v}.
[A|The] [hole|weakness|regression|leak|crash|race] in [the|a] {w} {w} of {p} [until|below|prior to] {v} [exposes|drops|corrupts] {w}.
[migrate|move|switch|port it|upgrade] to {p}[.|, then {w}.|; {p} is next.]
[nothing|no rights|no data|nobody|only {w}] in {p}. [It|That] [stays|helps].
{p} [and|or|vs|vs.|plus] {p} [share|split|need] {n} {w}.
{p} {p} {v}
{X} [exist|exists|look|looks|is|are|seems|needs|shows|of|for|in|on|a la|de la|die|der|des|du|les|el|los|to|from|with|at] [the|a|this|any|{w}|{v}] {w} {w}[.|:|?]
{X}: {w} {w} {n}
{X} [exist|looks|sind|sont|son|rules|a|an|en|dans|la|le] {w} {v}[.|, {w} {n}.]
[-|*|<li>|##|1.] {X} [looks|needs|for|of|is|in|was|a la|der] {w} {w}
NEITHER {W}{W} NOR {W}{W} [READS|KEEPS|MOVES] {n} {W}, [ITS|THE] {W} {X} {W}{W} AND {W}.
[ONCE|EVERY|WHEN] {W} {W} [REORDERS|READS] {W}{W} AND {W}{W}, {W} [GOES|FAILS].
("[JSON|YAML|TLS|LDAP|CORS|{W}] {w} [reads|keeps|is] {w}", {n})
{X}, {X} and {X} [need|are|stay] {w}.
[passer|migrer|basculer] [vers|à] {p}[.| avant {v}.]
[migrar|cambiar|pasar] a {p}[.| antes de {v}.]
[Umstieg|Wechsel|Umzug] [auf|zu] {p} [lohnt|hilft|folgt].
[Ein Wechsel|Ein Umzug|Die Abkehr|Der Abschied|Das Warten] [auf|zu|von] {p} [bleibt|wäre|ist|war|hat] [nötig|teuer|möglich|gedauert].
[We|They|I] [hold|froze|tested|patched|forked|updated|upgraded|deployed|dropped] {p} [at|to|on|from] {v} [as|and|until|because|while] [a|the|{w}] {w}.
[People|Teams|Vendors|Authors|Developers|Customers] [of|behind|using|around] {p} [plan|hope|agreed|refused|intend] to {w} the {w} {w}.
{X} [exist|remain|stop|grow|matter|cost|follow|help] [for|in|on|with] [the|{v}|both|older] [and|or|{w}] {w} {w}.
[Notifique|Verifique|Publique|Aplique|Modifique|Autorice|Sincronice|Normalice|Utilice|Analice|Finalice|Localice] [a la|el|la|los|en la] [versión|paquete|regla|rama] {v} [y|o] [repita|espere|siga] [el|la] [prueba|paso|copia][.| antes de {v}.]
[Reinicie|Compruebe|Instale|Elimine|Configure|Desactive|Cambie|Revise|Descargue|Consulte] [el|la|los|las|a la|en el] [servicio|paquete|regla|versión|rama|índice] {v}[.| y {f}.| o espere.]
[Redémarrez|Vérifiez|Installez|Supprimez|Désactivez|Consultez|Changez|Relisez] [le|la|les|à la|dans le] [service|paquet|règle|version|branche] {v}[.| puis {f}.| ou attendez.]
[Starten|Prüfen|Löschen|Installieren|Beachten|Wählen|Ändern] Sie [den|die|das] [Dienst|Paket|Regel|Zweig|Ablage] {v}[.| und {f}.]
[Checkpoints|Endpoints|Imports|Snapshots|Patches|Mirrors|Fallbacks|Artifacts|Binaries|Advisories|Signatures|Sandboxes] [exist|remain|are kept|are out|stay] for [the|] {v} [and|or] {v} [branches|lines|trains|series][.| only.]
[Workarounds|Regressions|Hotfixes|Downgrades|Backups|Symlinks|Wildcards|Tests|Timeouts|Rollbacks|Maintainers|Exploits] [exist|work|help|fail|are known|for|in|with|of] [the|older|{v}|most] [{w}|and {v}|branches] [{w}|only|too].
[Throughput|Usability|Observability|Determinism|Serialization|Concurrency|Tooling|Linting] [seems|is|was|stays] [ok|wrong|odd|fine|low|high]: {path} [imports|calls|loads] {w}.
{X} [seems|feels|is] [ok|wrong|odd|fine|low|high]: {path} [imports|calls|loads] {w} [and|or] {f}.
{X} [a|la|el|los|las|le|les|die|den|das] {w} {v} [y|et|und] {w} [la|el|le|die|der] {w}.
{X} [needs|drops|guards] {X}; {X} [and|or] {X} [stay|are] [on|off].
In {X}, {w} {w} [is|was] {w}. {X} {v} [fixes|keeps] it.
"{X}" [is|means] {w} {w}[.| in {p}.]
[Only|Just|About|Nearly] {n} [left|remain|pass|fail]. [Most|Some|Few|Many|None] [are|were] [old|new|slow]. [Others|Both|These|Those] [wait|pass].
[There|Here] [is|was] [a|one] {w}. [It|That] [needs|takes] {n} {w}. [Then|Next|Later|Afterwards|Finally], {w}.
[Without|With|Under|Behind|Beyond|Despite|During] {p}, [no|one] {w} {w} [is|was] [safe|lost].
[Cross-site|Server-side|Time-of-check|Use-after-free|Out-of-bounds] {w} in {f} [is|was] [known|rare].
[Upgrade|Rollback|Backup|Restore|Import|Export|Audit] [of|for] {p} [finished|failed|paused] [after|at] {n} {w}.
[Die|Eine|Jede|Diese] [Prüfung|Regel|Meldung|Funktion|Komponente|Schnittstelle|Warteschlange|Anwendung|Sicherung|Verbindung] [in|von|für] {p} [bricht ab|läuft|fehlt|hängt][.|, wenn {n} Einträge warten.| seit {v}.]
[Der|Ein|Jeder|Dieser] [Dienst|Fehler|Zugriff|Puffer|Aufruf|Schlüssel|Vorgang|Zeiger|Zähler|Angreifer] [in|von|aus] {p} [liest|schreibt|verliert|prüft] [Daten|Werte|Zeichen|Treffer|Einträge][.| nach {n} Sekunden.| ab {v}.]
[Das|Ein|Jedes|Dieses] [Modul|Paket|Ergebnis|Protokoll|Zertifikat|Verzeichnis|Programm] [in|von] {p} [enthält|meldet|zeigt] {n} [Fehler|Warnungen|Stellen|Zeilen], [davon|darunter] {n} [schwere|neue].
[Bitte|Danach|Anschließend|Vorher] [den Dienst|die Regel|das Paket] [neu starten|aktualisieren|löschen][.| und {f} aufrufen.]
[Nach|Vor|Ab|Seit|Ohne|Mit] [dem Neustart|der Umstellung|Version {v}|Korrektur|Prüfung] [bleibt|fehlt|steigt] [die Last|der Wert|das Ergebnis] [gleich|hoch|stabil].
[Ist|Wird|Kann|Soll] {f} [noch|wirklich|überhaupt] [nötig|gebraucht|sicher]?
[Le|Un|Chaque|Ce] [service|module|fichier|paquet|serveur|tampon|rapport|composant|champ] [de|dans] {p} [échoue|bloque|expose des données|perd {n} octets][.| depuis {v}.| après {n} essais.]
[La|Une|Chaque|Cette] [règle|routine|version|requête|branche|correction|valeur|ligne] [de|dans] {p} [touche|lit|copie|ignore] {n} [fichiers|lignes|champs][.| dans {path}.]
[Il faut|On peut|Mieux vaut|Pensez à] [relancer|vérifier|mettre à jour|supprimer] [le service|la règle|l'index|l'analyse] [avant|après] {v}.
[Aucune|Plusieurs|Certaines|Quelques] [alertes|erreurs|versions|réponses] [restent|manquent|sont fausses] [dans|pour] {p}.
[L'erreur|L'analyse|L'index|L'appel] [survient|revient|cesse] [si|quand] {f} [dépasse|atteint] {n}.
[El|Un|Cada|Este] [servicio|módulo|archivo|paquete|servidor|búfer|informe|componente|campo] [de|en] {p} [falla|bloquea|expone datos|pierde {n} octetos][.| desde {v}.| tras {n} intentos.]
[La|Una|Cada|Esta] [regla|rutina|versión|petición|rama|corrección|brecha|línea] [de|en] {p} [afecta|lee|copia|omite] {n} [archivos|líneas|campos][.| en {path}.]
[Hay que|Se puede|Conviene|Basta con] [reiniciar|revisar|actualizar|borrar] [el servicio|la regla|el índice] [antes|después] de {v}.
[Ninguna|Varias|Algunas|Muchas] [alertas|pruebas|versiones] [quedan|faltan|fallan] [en|para] {p}.
[Si|Cuando|Aunque|Porque] {f} [supera|alcanza] {n}, [el error|la alerta|el aviso] [vuelve|cesa].
[Gracias|Merci|Danke|Thanks|Merci beaucoup|Vielen Dank|Muchas gracias] [!|.|a todos.|an alle.|à tous.|everyone.]
[Uwaga|Atención|Achtung|Attention|Hinweis|Remarque|Nota|Wichtig]: {w} {w} ({v})
""".strip().split("\n")

_WORDS = (
    "adapter agent alert alias anchor backup batch binary blob bundle bus byte call channel charset chunk clock cluster column command console container context core counter credential cron daemon dashboard database deadline default digest disk domain driver "
    "editor endpoint engine entry event exception executor export field file filter firewall flag folder format form frame function gateway gem grant group guard handle heap helper hook icon image import index input instance interface item job kernel key label lambda "
    "latency layout lease level library license limit line link list listener lock login loop macro mask matrix memory menu message method metric migration mode model module monitor mount mutex namespace network node note notice object offset operator option order origin output "
    "package page panel parser password patch path pattern peer permission pipeline pixel pointer policy pool port prefix process profile prompt protocol proxy query queue quota range record region register release relay report resource response result retry role root route row rule "
    "runtime sample scanner schedule schema scope script secret segment sensor session setting shell signal socket source stack stage state stream string suite switch table tag target task template tenant thread ticket timer token topic trace trigger tuple type unit user value variable vault "
    "vector view volume warning window worker wrapper writer zone open stale broken unsafe remote hidden cached signed shared static public private dynamic invalid verbose atomic lazy strict minor nested remove create update scan parse read write send check build merge close validate encode decode reset"
).split()
_PRODUCT_HEADS = (
    "Anchor Apollo Arrow Atlas Badger Birch Blue Bolt Brook Castle Cedar Citrus Cloud Comet Coral Crystal Delta Dolphin Eagle East Echo Elm Express Fern Fire Forest Frost Garnet Golden Grand Hawk Hornet Ivory Jade Jasper Koala Lark Lemon Lotus Lynx Magnet Maple Metro Mint Moon Night North Nova Oak Ocean Olive Onyx Opal Orbit Otter Owl Panda "
    "Pearl Phoenix Pine Pixel Plum Poppy Prime Puma Quick Raven Red River Robin Rocket Royal Ruby Sage Sand Sapphire Shadow Sierra Sky Snow Solar South Spark Star Stone Storm Summit Sun Swift Tango Tiger Topaz Trout Turbo Ultra Union Urban Velvet Violet Viper Vista Wave West White Wind Wolf Yellow Zebra Zen"
).split()
_PRODUCT_TAILS = "Analyzer Balancer Base Builder Center Chain Client Cloud Connect Container Core Dashboard Desk Engine Flow Forge Framework Frame Graph Guard Hub Index Kit Lab Library Link Locker Log Manager Mail Monitor Net Office Pad Pilot Pipeline Platform Plugin Pool Reader Recorder Sensor Service Shell Shield Shop Stack Station Store Stream Suite Switch Sync Toolkit Viewer Wallet Watch Web Worker Writer Warden Keeper Planner Mapper Exporter Terminal Database Notebook Profiler Crawler Resolver Linter Formatter Tokenizer Sampler Orchestrator Installer Provisioner Debugger Bundler Transpiler Dispatcher Controller Validator".split()


class _Filler:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, pattern: str) -> str:
        """The pattern with each 9 replaced by a digit and each A by a capital letter."""
        return re.sub("[9A]", lambda m: str(self.r.randrange(10)) if m[0] == "9" else self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ"), pattern)

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def expand(self, line: str) -> str:
        """The line with one of each bracket's alternatives; the brackets don't nest."""
        return re.sub(r"\[([^\[\]]*\|[^\[\]]*)\]", lambda m: self.r.choice(m[1].split("|")), line)

    # -- names
    def made(self) -> str:
        r = self.r
        return r.choice(_STARTS) + "".join(r.choice(_MIDDLES) for _ in range(r.choice((0, 1, 1, 1, 2)))) + r.choice(_ENDS)

    def first(self) -> str:
        roll = self.r.random()
        return self.made().capitalize() if roll < 0.3 else self.r.choice(_PLAIN_GIVEN) if roll < 0.42 else self.r.choice(_KNOWN_GIVEN) if roll < 0.68 else self.r.choice(_GIVEN)

    def last(self) -> str:
        r = self.r
        one = lambda: self.made().capitalize() if r.random() < 0.5 else r.choice(_PLAIN_LAST) if r.random() < 0.2 else r.choice(_LAST)
        s, roll = one(), r.random()
        if roll < 0.05:
            return f"{s}-{one()}"
        if roll < 0.1:
            return r.choice(("van ", "van den ", "de ", "de la ", "von ", "von der ", "O'", "D'", "del ", "da ", "di ", "Mac", "Al-", "El-", "el-", "ter ", "Le ", "bin ")) + s
        return s

    def name(self) -> str:
        r, g, s = self.r, self.first(), self.last()
        i, roll = r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ"), r.random()
        if roll < 0.6:
            return f"{g} {s}"
        if roll < 0.68:
            return f"{g} {i}. {s}"
        if roll < 0.71:
            return f"{g} {self.first()} {s}"
        if roll < 0.79:
            return f"{s}, {g}"
        if roll < 0.88:
            return f"{i}. {s}"
        if roll < 0.9:
            return f"{i}.{r.choice(('', ' '))}{r.choice('ABCDEJKLMPRS')}. {s}"
        if roll < 0.92:
            return f"{s}, {i}."
        if roll < 0.94:
            return f"{s}, {g} {i}."
        if roll < 0.96:
            return f"{g}-{self.first()} {s}"
        if roll < 0.97:
            return f"{g} {s} {self.last()}"
        if roll < 0.98:
            return f"{s.upper()} {g}" if r.random() < 0.5 else f"{s.upper()}, {g}"
        return f"{g} {s}".upper()

    # -- places
    def town(self) -> str:
        r, roll = self.r, self.r.random()
        return r.choice(_TOWNS) if roll < 0.5 else r.choice(_TWO_WORD_TOWNS) if roll < 0.6 else (r.choice(_STARTS) + r.choice(_MIDDLES + [""] * 20) + r.choice(_TOWN_ENDS)).capitalize()

    def road(self) -> str:
        r = self.r
        return f"{r.choice(_ROAD_WORDS) if r.random() < 0.65 else self.made().capitalize()} {r.choice(_ROAD_KINDS)}"

    def address(self) -> str:
        r, n, t, d = self.r, self.r.randrange(1, 1900) if self.r.random() < 0.3 else self.r.randrange(1, 190), self.town(), self.digits
        five = d(r.choice(("99999", "09999")))
        flat = r.choice(("", "", "", f", Apt {r.randrange(1, 90)}", f", Apt. {r.randrange(1, 20)}{r.choice('ABCD')}", f", Flat {r.randrange(1, 40)}", f", Suite {r.randrange(1, 900)}", f", Unit {r.randrange(1, 60)}", f" #{r.randrange(1, 90)}", f", Floor {r.randrange(1, 30)}"))
        roll = r.random()
        if roll < 0.2:  # United States, Canada, Australia
            tail = r.choice((f"{t}, {r.choice(_STATES)} {d('99999')}", f"{t}, {r.choice(_STATES)} {d('99999')}", f"{t} {r.choice(_STATES)} {d('99999-9999')}", f"{t}, ON {d('A9A 9A9')}", f"{t} {r.choice(('NSW', 'VIC', 'QLD', 'WA'))} {d('9999')}", f"{t}, {d('99999')}", f"{t} {d('99999')}"))
            a = f"{n} {r.choice(('', '', '', 'N. ', 'West ', 'S '))}{self.road()}{flat}, {tail}"
        elif roll < 0.4:  # United Kingdom, Ireland
            house = r.choice((f"{n} ", f"{n} ", f"{n}{r.choice('ABC')} ", f"Flat {r.randrange(1, 30)}, {n} ", f"{self.made().capitalize()} House, {n} "))
            a = f"{house}{self.road()}{flat if house[0].isdigit() else ''}, {t}{r.choice((' ', ' ', ', '))}{d(r.choice(('A9 9AA', 'AA9 9AA', 'AA99 9AA', 'A99 9AA', 'AA9A 9AA', '99999', '99999')))}"
        elif roll < 0.58:  # Germany, Austria, Switzerland
            street = r.choice((r.choice(_DE_ROADS) + r.choice(_DE_KINDS), r.choice(_DE_ROADS) + r.choice(_DE_KINDS), self.made().capitalize() + r.choice(_DE_KINDS), f"{r.choice(('Am', 'An der', 'Im', 'Zum', 'Unter den'))} {r.choice(_DE_ROADS)}{r.choice(('', 'berg', 'hof', 'tor'))}", f"{r.choice(('Alte', 'Lange', 'Neue'))} {r.choice(('Gasse', 'Straße'))}"))
            a = f"{street} {n}{r.choice(('', '', ' a', 'a', 'b', '-' + str(n + 2)))}, {d(r.choice(('99999', '99999', 'D-99999', '9999')))} {t}"
        elif roll < 0.72:  # France, Belgium
            of = r.choice(("de la ", "du ", "des ", "de l'", "", "")) + r.choice(("Paix", "Marché", "Tilleuls", "Église", "République", "Fontaine", "Moulin", "Écoles", "Château", "Pasteur", "Gambetta", self.made().capitalize(), self.made().capitalize()))
            a = f"{n}{r.choice(('', '', ',', ' bis', ' ter,'))} {r.choice(('rue', 'rue', 'rue', 'avenue', 'boulevard', 'place', 'chemin', 'quai', 'allée', 'impasse'))} {of}, {five} {t}"
        elif roll < 0.86:  # Spain, Portugal, Italy
            of = r.choice(("de la ", "del ", "de ", "", "")) + r.choice(("Sol", "Constitución", "Puerta", "Río", "Pez", "Prado", "Rosario", "Libertad", "Nueva", "Garibaldi", "Flores", self.made().capitalize(), self.made().capitalize()))
            door = r.choice(("", "", f", {r.randrange(1, 9)}º {r.choice('ABCD')}", f", {r.randrange(1, 9)}.º izq.", f", piso {r.randrange(1, 9)}", f", bajo {r.choice('AB')}"))
            a = f"{r.choice(('Calle', 'Calle', 'C/', 'Avenida', 'Av.', 'Avda.', 'Paseo', 'Plaza', 'Rua', 'Via', 'Viale', 'Piazza', 'Ronda', 'Camino'))} {of}{r.choice((' ', ' ', ', '))}{n}{door}, {five} {t}"
        elif roll < 0.94:  # Netherlands, India
            a = r.choice((f"{self.made().capitalize()}{r.choice(('straat', 'laan', 'gracht', 'kade', 'plein', 'weg'))} {n}{r.choice(('', '-2', ' hs'))}, {d('9999 AA')} {t}", f"{r.choice(('Flat', 'Plot', 'No.', 'House'))} {n}, {r.choice(('', self.made().capitalize() + ' Apartments, ', 'Sector ' + str(n) + ', '))}{self.road()}, {t} {d(r.choice(('999999', '999 999')))}"))
        else:
            a = f"{n} {self.road()}, {self.town()}, {t} {five}"
        roll, at = r.random(), a.rfind(", ")
        if roll < 0.2 and at > 0:
            a = f"{a[:at]}{r.choice((chr(10), ',' + chr(10), ', ' + chr(10), chr(10) + '  ', chr(13) + chr(10)))}{a[at + 2 :]}"
        elif roll < 0.25:
            a = a.replace(", ", ",\n")
        return a

    # -- numbers
    def phone(self) -> str:
        r = self.r
        if r.random() < 0.45:
            return self.digits(self.pick(
                "(999) 999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "1.999.999.9999", "1.999.999.9999", "09.99.99.99.99", "09.99.99.99.99", "09.99.99.99.99", "999 999 9999", "+1 999 999 9999", "+1 (999) 999-9999", "+1-999-999-9999", "+19999999999", "1.999.999.9999", "1-999-999-9999", "9999999999",
                "09999 999999", "09999 999 999", "099 9999 9999", "+44 9999 999999", "+44 99 9999 9999", "+44 (0)9999 999 999", "(099) 9999 9999", "+33 9 99 99 99 99", "09 99 99 99 99", "09.99.99.99.99", "0099 99 999 9999",
            ))
        sep = r.choice((" ", " ", " ", "-", ".", "/"))
        groups = r.choice(((2, 4, 4), (3, 3, 4), (3, 3, 3), (1, 2, 2, 2, 2), (2, 3, 4), (2, 5, 3), (3, 5, 3), (4, 6), (2, 8), (3, 8), (5, 5), (2, 6), (3, 7), (2, 3, 2, 2), (3, 2, 2, 2), (2, 7), (4, 3, 3), (5, 3, 3), (5, 6)))
        body = sep.join("9" * g for g in groups)
        lead = r.choice(("+99 ", "+99 ", "+999 ", "+99-", "0", "0", "00", "0099 ", "+99 (0)", "(0", "+99", "0099/"))
        if lead == "(0":
            return self.digits(f"(0{'9' * (groups[0])}) {sep.join('9' * g for g in groups[1:])}")
        tail = r.choice(("", "", "", "", "", "-9", "-99", "-999")) if sep != "-" and len(groups) < 4 else ""
        return self.digits(lead + body + tail)

    def identity(self) -> tuple[str, str]:
        """(label, number)."""
        r, d = self.r, self.digits
        gap = lambda *words: r.choice(words) + r.choice((" ", " ", ": ", " no. ", " no ", " number ", " # "))
        return r.choice(
            (
                lambda: (gap("SSN", "social security number", "social security", "Social Security No.", "soc. sec."), d(r.choice(("999-99-9999", "999-99-9999", "999 99 9999", "999999999")))),
                lambda: (gap("NINO", "NI number", "National Insurance", "national insurance number", "NI"), d(r.choice(("AA999999", "AA 99 99 99 ", "AA 99 99 99 ", "AA-99-99-99-"))) + r.choice("ABCD")),
                lambda: (gap("tax id", "tax ID", "Steuer-ID", "Steuernummer", "TIN", "IdNr.", "tax number", "numéro fiscal"), d(r.choice(("99 999 999 999", "99 999 999 999", "99999999999", "99/999/99999", "999/999/99999", "99-9999999", "999-99-999")))),
                lambda: (gap("CPF", "CPF", "tax id", "tax payer id", "contribuinte"), d(r.choice(("999.999.999-99", "999.999.999-99", "99999999999")))),
                lambda: (gap("DNI", "NIE", "NIF", "documento", "DNI/NIF"), d(r.choice(("99999999A", "99999999-A", "99.999.999-A", "A9999999A", "A-9999999-A")))),
                lambda: (gap("national id", "personnummer", "national ID", "identity number", "CPR", "personal number", "civil registration"), d(r.choice(("999999-9999", "99999999-9999", "999999 9999", "999999-99999", "9999999999", "999999/9999")))),
                lambda: (gap("passport", "Passport", "passport number", "Reisepass", "passeport", "pasaporte", "travel document"), d(r.choice(("AA9999999", "99AA99999", "A99999999", "A9A99A999", "AAA999999", "999999999", "A9999999")))),
                lambda: (gap("driving licence", "driver's license", "driver licence", "licence", "Führerschein", "permis de conduire", "DL"), d(r.choice(("AAAAA999999AA", "AAAAA999999AA9AA", "A999-9999-9999", "A9999999", "AA99 99999999999", "A99999999999", "AAAAA999999A99AA", "99AA99999")))),
                lambda: (gap("Aadhaar", "Aadhaar", "UID"), d("9999 9999 9999")),
                lambda: (gap("PAN", "PAN card", "BSN", "PESEL", "SIN", "CURP", "Ausweis", "ID card"), d(r.choice(("AAAAA9999A", "999999999", "99999999999", "999-999-999", "999 999 999", "AAAA999999AAAAAA99", "A99A99999", "AAA 999999")))),
                lambda: (gap("codice fiscale", "NIR", "numéro de sécurité sociale", "n° de sécurité sociale", "INSEE"), d(r.choice(("AAAAAA99A99A999A", "9 99 99 99 999 999 99", "999999999999999", "9 99 99 99 999 999")))),
            )
        )()

    # -- mail
    def email(self) -> str:
        r = self.r
        plain = lambda s: re.sub(r"[^a-z]", "", s.lower()) or "kim"
        g, s = plain(self.first()), plain(self.last())
        local = r.choice((f"{g}.{s}", f"{g}.{s}", f"{g}-{s[0]}", f"{g}_{s}", f"{g[0]}{s}", f"{s}{r.randrange(100)}", f"{g}+{r.choice(('oss', 'git', 'list', 'news'))}", f"{s}.{g[0]}", r.choice(_BOXES), r.choice(_BOXES), g, f"{g}{r.randrange(1950, 2010)}", f"{g[0]}.{s}"))
        host = r.choice(_HOSTS) + r.choice(_HOST_ENDS) if r.random() < 0.6 else plain(self.made()) + r.choice(("", "", "-it", "-labs"))
        domain = [*([r.choice(("mail", "dev", "lists", "corp", "team", "eu", "it", "staff"))] if r.random() < 0.25 else []), host, r.choice(_DOMAINS)]
        if r.random() < 0.05:
            local, domain = local.upper(), [x.upper() for x in domain]
        at, dot = r.choice((("@", "."),) * 14 + ((" @ ", "."), (" @ ", "."), ("(at)", "(dot)"), ("(at)", "."), (" (at) ", " (dot) "), (" (at) ", "."), (" [at] ", " [dot] "), (" [at] ", "."), ("[at]", "[dot]"), ("[at]", "."), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "), ("&#64;", "."), ("&#64;", "."), ("{at}", "."), (" @ ", " . ")))
        return f"{local}{at}{dot.join('.'.join(domain).split('.'))}"

    # -- what isn't personal
    def filler(self, line: str) -> str:
        r = self.r
        num = lambda: str(r.randrange(1, 900))
        w = lambda: r.choice(_WORDS) if r.random() < 0.85 else self.made().lower()
        doer = lambda: r.choice(_WORDS).capitalize().rstrip("e") + r.choice(("e", "er", "er", "or", "ing", "s"))
        tail = lambda: r.choice(_PRODUCT_TAILS) if r.random() < 0.6 else doer()
        prod = lambda: f"{r.choice(_PRODUCT_HEADS) if r.random() < 0.6 else self.made().capitalize() if r.random() < 0.6 else doer()}{r.choice((' ', ' ', ' ', ' ', '', '-'))}{tail()}"
        slot = {
            "p": prod, "w": w, "W": lambda: w().upper(), "T": lambda: w().capitalize(), "X": lambda: r.choice((self.made().capitalize(), r.choice(_WORDS).capitalize() + r.choice(("", "s", "ing", "er", "ation", "ability", "e", "en", "ar", "ez", "ice", "iere", "side", "points", "ment", "ungen")))), "n": num, "ip": lambda: ".".join(str(x) for x in (r.choice((10, 10, 10, 127, 172, 192, 8, r.randrange(1, 224))), *(r.randrange(0, r.choice((60, 255))) for _ in range(3)))), "v": lambda: f"{r.randrange(12)}.{r.randrange(40)}" + (f".{r.randrange(20)}" if r.random() < 0.8 else ""), "y": lambda: str(r.randrange(2008, 2027)),
            "k": lambda: str(r.randrange(1, 10 ** r.randrange(1, 4))), "d2": lambda: self.digits("99"), "d5": lambda: self.digits("99999"), "d6": lambda: self.digits("999999"), "st": self.road, "g": w, "date": lambda: self.pick(self.digits("1999-09-19"), self.digits("09.1.1999"), self.digits("19/09/1999"), f"{r.randrange(1, 29)} {r.choice(('May', 'June', 'Oct', 'March'))} {r.randrange(1950, 2026)}", "Monday"),
            "f": lambda: r.choice("get set run init make do find read write handle update create remove send apply sort".split()) + r.choice(("", "_")).join(("", w().capitalize())), "path": lambda: f"{w()}/{r.choice(('', w() + '/'))}{w()}.{r.choice('py js go rb java cs ts php c rs kt sh yml'.split())}",
        }
        out = re.sub(r"\{(ip|k|p|w|W|T|X|n|v|y|d2|d5|d6|st|g|f|path|date)\}", lambda m: slot[m[1]](), self.expand(line))
        return out.replace("{{", "{").replace("}}", "}").replace("\\n", "\n").replace("\\t", "\t")


_SLOT = re.compile(r"(\{(?:t|m|name|first|last|id|number|phone|email|address)\})")


def labelled_rows(repeats: int = 40, negative_repeats: int = 60, seed: int = 7, carriers: list[str] | None = None, negatives: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): the labelled table, repeats rows of each carrier and as many negatives as a third of negative_repeats for each."""
    f = _Filler(seed)
    out = []
    plain = [f.filler(x) for x in negatives or NEGATIVES for _ in range(negative_repeats)]
    for line in carriers or CARRIERS:
        for _ in range(repeats):
            text, spans = "", []

            def put(value: str, kind: str | None = None) -> None:
                nonlocal text
                if kind:
                    spans.append((len(text), len(text) + len(value), kind))
                text += value

            gap = f.pick(" ", " ", "\n", "\n\n", "\n- ", "\n\t", "\r\n", "  ", "</li>\n<li>", "</p><p>")
            if f.r.random() < 0.5:
                put(f.r.choice(plain) + gap)
            for part in _SLOT.split(f.expand(line)):
                slot = part[1:-1] if _SLOT.fullmatch(part) else ""
                if slot in ("t", "m"):
                    put(f.r.choice(TITLES if slot == "t" else FRENCH_TITLES))
                elif slot in ("name", "first", "last"):
                    put(getattr(f, slot)(), "name")
                elif slot in ("id", "number"):
                    label, number = f.identity()
                    put(label if slot == "id" else "")
                    put(number, "identity_number")
                elif slot in ("phone", "email"):
                    put(getattr(f, slot)(), slot)
                elif slot == "address":
                    put(f.address(), "street_address")
                else:
                    put(f.filler(part))
            if f.r.random() < 0.5:
                put(gap + f.r.choice(plain))
            out.append((text, spans))
    f.r.shuffle(plain)
    out += [(f.pick(" ", "\n", "\n\n", "</li>\n<li>").join(plain[i : i + 3]), []) for i in range(0, len(plain), 3)]
    f.r.shuffle(out)
    return out
