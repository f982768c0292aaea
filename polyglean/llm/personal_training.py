"""Training sentences for the personal-information model, written by rules.

Names and places are drawn from made-up syllables and from capitalized words of a public tokenizer's vocabulary, so no
list of names is needed. Numbers follow national conventions with all digits and groupings drawn. Sentences are
grouped by slot: {N} name, {A} street address, {I} identity number, {P} phone number, {E} email address; {c} city,
{b} number of another kind, {n} small number, {W} two or three capitalized words that name no person.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

LANGS = ("en", "es", "fr", "de", "pt", "hi")

NAMES = {
    "en": "This recipe comes from {N}.|{N} said the oven was too hot.|I asked {N} about the trip.|Written by {N}|Author: {N}|Hello, I'm {N}, and this is my blog.|Thanks to {N} for the photos.|Many thanks to {N} and the whole team.|According to {N}, nobody saw it.|Please speak to {N} at the front desk.|Yours sincerely,\n{N}|Cheers,\n{N}|Love,\n{N}|Mrs. {N} taught us to knit.|Mr {N} retired in June.|Prof. {N} gave a talk.|My friend {N} likes tea.|Last week {N} won a prize.|Interview with {N}|picture: {N}|Name: {N}|{N} is my neighbour.|The sister of {N} lives next door.|Signed: {N}|{N} wrote to the paper.|We met {N} at the fair.|a story told by {N}|({N}, aged 40)|Today {N} showed us the way.|Dear {N},|Please contact {N} for details.|The cat of {N} ran away.|as heard from {N}",
    "es": "Esta receta es de {N}.|{N} dijo que no vendría.|Pregunté a {N} por el viaje.|Escrito por {N}|Autora: {N}|Hola, soy {N} y vivo aquí.|Gracias a {N} por las fotos.|Según {N}, nadie lo vio.|Hable con {N} en la recepción.|Atentamente,\n{N}|Saludos,\n{N}|La señora {N} nos enseñó a coser.|Don {N} se jubiló en junio.|Mi amiga {N} toma té.|La semana pasada {N} ganó un premio.|Entrevista con {N}|Nombre: {N}|Conocimos a {N} en la feria.|El hermano de {N} vive al lado.|Firmado: {N}|Hoy {N} nos mostró el camino.|Imagen: {N}|Querida {N}:",
    "fr": "Cette recette vient de {N}.|{N} a dit que non.|J'ai parlé à {N} du voyage.|Écrit par {N}|Auteur : {N}|Bonjour, je m'appelle {N} et je vis ici.|Merci à {N} pour les photos.|Selon {N}, personne ne l'a vu.|Adressez-vous à {N} à l'accueil.|Cordialement,\n{N}|Amitiés,\n{N}|Madame {N} nous a appris à coudre.|Monsieur {N} est parti en juin.|Mon amie {N} aime le thé.|La semaine dernière {N} a gagné un prix.|Entretien avec {N}|Nom : {N}|Nous avons rencontré {N} à la foire.|Le frère de {N} habite à côté.|Signé : {N}|Aujourd'hui {N} nous a montré le chemin.|Image : {N}|Chère {N},|Sincèrement,\n{N}|Bien cordialement,\n{N}|Contactez {N} pour la suite.",
    "de": "Dieses Rezept stammt von {N}.|{N} sagte, der Ofen sei zu heiß.|Ich fragte {N} nach der Reise.|Geschrieben von {N}|Autorin: {N}|Hallo, ich heiße {N} und wohne hier.|Danke an {N} für die Bilder.|Laut {N} hat es keiner gesehen.|Wenden Sie sich an {N} am Empfang.|Mit freundlichen Grüßen\n{N}|Herzlich,\n{N}|Frau {N} hat uns das Stricken gezeigt.|Herr {N} ging im Juni in Rente.|Meine Freundin {N} trinkt Tee.|Letzte Woche gewann {N} einen Preis.|Gespräch mit {N}|Name: {N}|Wir trafen {N} auf dem Fest.|Der Bruder von {N} wohnt nebenan.|gezeichnet {N}|Heute zeigte uns {N} den Weg.|Bild: {N}|Liebe {N},|Bitte kontaktieren Sie {N} dazu.|Grüßen Sie {N} von mir.|Fragen an {N} richten.",
    "pt": "Esta receita é de {N}.|{N} disse que não vinha.|Perguntei a {N} sobre a viagem.|Escrito por {N}|Autora: {N}|Olá, chamo-me {N} e vivo aqui.|Obrigado a {N} pelas fotos.|Segundo {N}, ninguém viu.|Fale com {N} na recepção.|Atenciosamente,\n{N}|Cumprimentos,\n{N}|A senhora {N} ensinou-nos a coser.|O doutor {N} se aposentou em junho.|Minha amiga {N} toma chá.|Na semana passada {N} ganhou um prémio.|Entrevista com {N}|Nome: {N}|Conhecemos {N} na feira.|O irmão de {N} mora ao lado.|Assinado: {N}|Hoje {N} mostrou o caminho.|Imagem: {N}|Querida {N},",
    "hi": "लेखक: {N}|यह विधि {N} की है।|{N} ने कहा कि चूल्हा गरम था।|मैंने {N} से यात्रा के बारे में पूछा।|नमस्ते, मैं {N} हूँ और यहीं रहता हूँ।|तस्वीरों के लिए {N} को धन्यवाद।|कृपया {N} से बात करें।|धन्यवाद,\n{N}|भवदीय,\n{N}|श्रीमती {N} ने हमें सिलाई सिखाई।|श्री {N} जून में सेवानिवृत्त हुए।|डॉ. {N} आज नहीं हैं।|मेरी सहेली {N} चाय पीती है।|पिछले हफ़्ते {N} ने इनाम जीता।|नाम - {N}|हम मेले में {N} से मिले।|चित्र: {N}|आज {N} ने रास्ता दिखाया।|प्रिय {N},|परसों {N} मिठाई लाए।|सुबह {N} अख़बार पढ़ते हैं।|शाम को {N} हमारे घर आईं।|यह चिट्ठी {N} को दे दो।",
}
ADDRESSES = {
    "en": "Our office is at {A}.|Visit us: {A}|My aunt moved to {A} last year.|Deliver it to {A} before noon.|Location: {A}|He lives at {A}.|{A}",
    "es": "La oficina está en {A}.|Visítenos: {A}|Mi tía se mudó a {A}.|Entregar en {A} antes del mediodía.|Domicilio: {A}|{A}",
    "fr": "Le bureau se trouve {A}.|Venez nous voir : {A}|Ma tante habite au {A}.|À livrer au {A} avant midi.|Domicile : {A}|{A}",
    "de": "Das Büro ist in der {A}.|Besuchen Sie uns: {A}|Meine Tante zog in die {A}.|Liefern Sie bis Mittag an {A}.|Wohnort: {A}|{A}",
    "pt": "O escritório fica na {A}.|Visite-nos: {A}|Minha tia mudou para a {A}.|Entregar na {A} antes do meio-dia.|Residência: {A}|{A}",
    "hi": "दफ़्तर {A} पर है।|मेरी मौसी {A} में आ गईं।|सामान {A} पर पहुँचाएँ।|निवास: {A}|{A}",
}
IDENTITIES = {
    "en": "ID number {I}|SSN {I}|Social security number: {I}|passport {I} expired|Passport number: {I}|Tax ID: {I}|NHS number {I}|my insurance number is {I}|credit card {I}|Card no. {I} was blocked.|identity card {I}|driver's licence {I}",
    "es": "DNI {I}|NIE: {I}|NIF {I}|pasaporte {I} caducado|Número de identidad: {I}|seguridad social {I}|tarjeta {I} bloqueada|documento de identidad {I}",
    "fr": "Numéro de sécurité sociale {I}|passeport {I} périmé|Carte d'identité : {I}|numéro fiscal : {I}|carte bancaire {I} bloquée|assurance n° {I}",
    "de": "Personalausweis {I}|Reisepass {I} ist abgelaufen|Steuer-ID: {I}|Steuernummer {I}|Versicherungsnummer {I}|Kreditkarte {I} gesperrt|Ausweisnummer: {I}",
    "pt": "CPF {I}|RG: {I}|NIF {I}|passaporte {I} vencido|Cartão de cidadão: {I}|identidade {I}|cartão {I} bloqueado|Segurança social: {I}",
    "hi": "आधार संख्या {I}|पैन: {I}|पासपोर्ट संख्या {I}|पहचान पत्र {I}|बीमा संख्या {I}|कार्ड {I} बंद है",
}
PHONES = {
    "en": "Phone {P}|Telephone: {P}|mobile: {P}|Fax {P}|cell {P}|Ring us on {P} any time.|You can call me at {P}.|Dial {P} now.|My number: {P}|WhatsApp {P}|Reach me on {P}, extension 4.|Someone picks up at {P} most days.|Text messages to {P}, ext. 21.|{P}|({P})",
    "es": "Teléfono: {P}|móvil {P}|Llámenos: {P}|Puede llamar a {P} ahora.|Número: {P}|fax {P}|{P}|({P})",
    "fr": "Téléphone : {P}|portable {P}|Appelez-nous : {P}|Vous pouvez appeler {P}.|Numéro : {P}|fax {P}|{P}|({P})",
    "de": "Telefon: {P}|Handy {P}|Rufen Sie an: {P}|Sie erreichen uns unter {P}.|Rufnummer: {P}|Fax {P}|{P}|({P})",
    "pt": "Telefone: {P}|telemóvel {P}|celular: {P}|Ligue agora: {P}|Pode ligar para {P}.|Número: {P}|{P}|({P})",
    "hi": "फ़ोन: {P}|मोबाइल {P}|कॉल करें: {P}|मेरा फ़ोन नंबर {P}|आप {P} पर बात कर सकते हैं।|दूरभाष {P}|{P}|({P})",
}
EMAILS = {
    "en": "Email: {E}|Mail me at {E} please.|Send it to {E}.|Contact: {E}|<{E}>|mailto:{E}|{E}|({E})",
    "es": "Correo electrónico: {E}|Envíelo a {E}.|{E}|({E})",
    "fr": "Courriel: {E}|Envoyez-le à {E}.|{E}|({E})",
    "de": "E-Mail: {E}|Senden Sie es an {E}.|{E}|({E})",
    "pt": "Correio: {E}|Envie para {E}.|{E}|({E})",
    "hi": "ई-मेल: {E}|इसे {E} पर भेजें।|{E}|({E})",
}
#: Sentences without any personal information.
OTHERS = {
    "en": "Invoice {b} was paid.|Your order {b} has been sent.|ISBN {b}|Item {b}, page {n}|Lot {b} weighs {n} kg.|Version {v} is out.|It costs {m}.|{y} was a good year.|at {g}|The {c} Bridge is old.|We flew to {c} and {c}.|{c} Street is long.|{W} is a shop in {c}.|The {W} Club meets on Monday.|Hotel {W} opens at {n}.|Bake for {n} minutes.|Some say that {c} is pretty.|In {c}, people like music.|Every Child Needs A Book|A Short Guide To {c}|Cafe {W} sells tea.|Old {c} Market|The team from {c} beat {c} by {n} goals.|Reference: {b}|Model {b} has {n} buttons.|Both {c} and {c} have a river.|Sunday in {c}: Music And Food|{c} Castle, {c} Lake and {c} Park are near.|The {W} company makes cheese.|READ THIS BEFORE YOU OPEN THE BOX.|When {c} woke up, {c} was covered in snow.|Yesterday evening it rained. Nobody came.|Serial number {b}|tracking no. {b}|Boxes {b} to {b} are kept by date.|They sold crates {b} as one lot.|Room {n}, shelf {b}, sorted by size|Fine {W} butter is on offer.|Fresh {W} honey costs {m}.|New {W} shoes came in.|Try our {W} soap.",
    "es": "La factura {b} está pagada.|Su pedido {b} ha salido.|ISBN {b}|Artículo {b}, página {n}|Lote {b} pesa {n} kg.|Versión {v} lista.|Cuesta {m}.|{y} fue un buen año.|El puente de {c} es viejo.|Fuimos a {c} y {c}.|La calle {c} es larga.|{W} es una tienda de {c}.|El Club {W} se reúne el lunes.|Hotel {W} abre a las {n}.|En {c} gusta la música.|El Bar {W} vende té.|Referencia: {b}|El equipo de {c} ganó a {c}.|Hornear {n} minutos.|Mercado Viejo de {c}|Ayer por la tarde llovió. Nadie vino.|Castillo {c} y Lago {c}|El aceite {W} es suave.|Nuevo jabón {W} en oferta",
    "fr": "La facture {b} est payée.|Votre commande {b} est partie.|ISBN {b}|Article {b}, page {n}|Lot {b} pèse {n} kg.|Version {v} prête.|Prix : {m}.|{y} fut une bonne année.|Le pont de {c} est vieux.|Nous allons à {c} et à {c}.|La rue de {c} est longue.|{W} est une boutique de {c}.|Le Club {W} se réunit lundi.|Hôtel {W} ouvre à {n} heures.|À {c}, on aime la musique.|Le Bar {W} vend du thé.|Référence : {b}|L'équipe de {c} a battu {c}.|Cuire {n} minutes.|Hier soir il a plu. Personne n'est venu.|Château {c} et Lac {c}|Le vin {W} est doux.|Nouveau savon {W} en promotion",
    "de": "Die Rechnung {b} ist bezahlt.|Ihre Bestellung {b} ist unterwegs.|ISBN {b}|Artikel {b}, Seite {n}|Posten {b} wiegt {n} kg.|Version {v} ist fertig.|Es kostet {m}.|{y} war ein gutes Jahr.|Die Brücke von {c} ist alt.|Wir fuhren nach {c} und {c}.|Die {c}straße ist lang.|{W} ist ein Laden in {c}.|Der Verein {W} trifft sich am Montag.|Hotel {W} öffnet um {n} Uhr.|In {c} mag man Musik.|Das Gasthaus {W} hat Tee.|Nummer der Ware: {b}|Die Mannschaft aus {c} schlug {c}.|Backen Sie {n} Minuten.|Gestern Abend fiel Regen. Niemand kam.|Dieses Buch und Jener Film|Manche Kinder mögen Hunde und Katzen.|Der Garten, die Küche und das Bad sind neu.|Schloss {c} und See {c}|Die Butter {W} ist mild.|Neue {W} Seife im Angebot|Wer Kaffee trinkt, mag oft auch Kuchen.",
    "pt": "A fatura {b} está paga.|A sua encomenda {b} saiu.|ISBN {b}|Artigo {b}, página {n}|Lote {b} pesa {n} kg.|Versão {v} pronta.|Custa {m}.|{y} foi um bom ano.|A ponte de {c} é velha.|Fomos a {c} e {c}.|A rua {c} é longa.|{W} é uma loja de {c}.|O Clube {W} reúne na segunda.|Hotel {W} abre às {n}.|Em {c} gostam de música.|O Bar {W} vende chá.|Referência: {b}|A equipa de {c} venceu {c}.|Assar {n} minutos.|Ontem à noite choveu. Ninguém veio.|Castelo {c} e Lago {c}|O azeite {W} é suave.|Novo sabonete {W} em promoção",
    "hi": "बिल {b} चुका दिया।|आपका ऑर्डर {b} निकल गया।|पन्ना {n}, अंक {b}|संस्करण {v} तैयार है।|क़ीमत {m} है।|{y} अच्छा साल था।|{c} का पुल पुराना है।|हम {c} और {c} गए।|{c} मार्ग लंबा है।|{c} {c} की दुकान पुरानी है।|{n} मिनट पकाएँ।|{c} में संगीत पसंद है।|कल शाम बारिश हुई।|बच्चे स्कूल गए और खेलने लगे।|अब सब घर आ गए हैं।|चाय और बिस्कुट मेज़ पर हैं।|लोग अब कम चिट्ठी लिखते हैं।|नया साल सबके लिए शुभ हो।|{c} से {c} तक सड़क है।|माँ ने खाना बनाया, फिर सबने खाया।|दादी की कहानी सुनकर नींद आ गई।|रसोई में दूध और चीनी रखी है।|मराठी भाषा सुंदर आहे, आणि लोक ती बोलतात।|आज सकाळी पाऊस पडला, पण शाळा सुरू होती।|जब गाड़ी रुकी, तब सब उतरे।",
}

_ONSET = "b bl br c ch d dr f fl fr g gr h j k kl kr l m n p pl pr qu r rh s sch sh sl st t th tr v w z".split()
_NUCLEUS = "a e i o u a e i o ai au ea ee ie oa ou".split()
_CODA = ["", "", "", "l", "m", "n", "r", "s", "t", "ck", "nd", "rt", "ng", "x", "tz", "ll"]
_DEVA, _SIGN = "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह", ["", "", "ा", "ि", "ी", "ु", "ू", "े", "ै", "ो", "ं"]


class Writer:
    """Draws names, places, numbers and sentences.

    ``proper``: capitalized words a name or place may be. ``ordinary``: words of the sentence, Latin and Devanagari.
    ``other``: more ordinary words, which a given name may be too.
    """

    def __init__(self, rng: random.Random, proper: Sequence[str] = (), ordinary: Sequence[str] = (), other: Sequence[str] = ()):
        self.r, self.proper, self.more = rng, list(proper), [w for w in other if w < "\u0900"]
        self.ordinary = [w for w in ordinary if w < "\u0900"], [w for w in ordinary if w >= "\u0900"]

    def syllables(self, deva: bool = False) -> str:
        r = self.r
        if deva:
            return "".join(r.choice(_DEVA) + r.choice(_SIGN) for _ in range(r.choice((2, 2, 3, 3, 4))))
        w = "".join(r.choice(_ONSET) + r.choice(_NUCLEUS) for _ in range(r.choice((1, 2, 2, 3)))) + r.choice(_CODA)
        if r.random() < 0.15:
            w = w.replace(r.choice("aeiou"), r.choice("áéíóúäöüèêãç"))
        return w.capitalize()

    def word(self, lang: str) -> str:
        if lang != "hi" and self.proper and self.r.random() < 0.3:
            return self.r.choice(self.proper)
        return self.syllables(lang == "hi")

    def name(self, lang: str) -> str:
        r, g, f = self.r, self.word(lang), self.word(lang)
        if lang != "hi" and self.more and r.random() < 0.08:  # some names are words as well
            g = r.choice(self.more).capitalize()
        if r.random() < 0.13:
            f += f"-{self.word(lang)}"
        elif r.random() < 0.06:
            g += f"-{self.word(lang)}"
        x = r.random()
        if lang == "hi":
            return f"{g} {f}"
        initial = f"{r.choice('ABCDEFGHIJKLMNOPRSTUVWZ')}."
        n = f"{g} {f}" if x < 0.66 else f"{f}, {g}" if x < 0.8 else f"{g} {initial} {f}" if x < 0.92 else f"{initial} {f}" if x < 0.95 else f"{g} {self.word(lang)} {f}"
        return n.upper() if r.random() < 0.1 else n

    def noise(self, lang: str) -> str:
        """Ordinary and made-up words in no known context, without a name."""
        r, deva, out = self.r, lang == "hi", []
        for k in range(r.randint(4, 12)):
            if self.ordinary[deva] and r.random() < (0.3 if deva else 0.55):
                w = r.choice(self.more if not deva and self.more and r.random() < 0.4 else self.ordinary[deva])
            else:
                w = self.syllables(deva)
                w = w if deva or out and out[-1].islower() and r.random() < 0.3 else w.lower()
            if not deva and r.random() < 0.12:  # nouns and titles
                w = w.capitalize()
            out.append((w.capitalize() if not k and not deva else w) + r.choices(("", ",", ":"), (82, 12, 6))[0])
        return " ".join(out).rstrip(",:") + ("।" if deva else ".")

    def digits(self, n: int) -> str:
        return "".join(str(self.r.randrange(10)) for _ in range(n))

    def native(self, s: str, lang: str) -> str:
        return "".join(chr(0x966 + int(c)) if c.isdigit() else c for c in s) if lang == "hi" and self.r.random() < 0.3 else s

    def phone(self, lang: str) -> str:
        """International or national prefix, area code and groups, joined in one of the usual ways."""
        r = self.r
        sep = r.choice((" ", " ", " ", "-", "-", ".", "/"))
        cc = r.choice(("+", "+", "00", "")) if r.random() < 0.5 else None
        lengths = r.choice(((3, 4), (4, 4), (3, 3), (2, 2, 2), (2, 2, 2, 2), (3, 3, 3), (4, 3), (3, 2, 2), (5,), (6,), (8,), (5, 3), (6, 3), (4, 3, 3), (3, 3, 4), (5, 4), (5, 5), (2, 4, 4), (1, 4, 4)))
        groups = [self.digits(n) for n in lengths]
        area = ("0" if r.random() < 0.6 else "") + self.digits(r.choice((1, 2, 2, 3, 3, 4)))
        if r.random() < 0.15:  # all digits together
            return self.native((r.choice(("0", "+", "")) + self.digits(r.choice((9, 10, 11, 12)))), lang)
        if cc is None:
            x = r.random()
            head = f"({area}){r.choice((' ', ''))}" if x < 0.35 else area + r.choice((sep, " ", "/"))
            return self.native(head + sep.join(groups), lang)
        code = cc + (r.choice("123456789") + self.digits(r.choice((0, 1, 1, 2))) if cc else r.choice("17"))
        between = r.choice((" ", sep))
        head = f"({area}){r.choice((' ', ''))}" if r.random() < 0.25 else area + sep if r.random() < 0.7 else ""
        return self.native(code + between + head + sep.join(groups), lang)

    def identity(self, lang: str) -> str:
        """Letters and digits in groups as on passports, tax, insurance, identity and payment cards."""
        r, up = self.r, lambda n: "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
        d = self.digits
        forms = (
            lambda: "-".join((d(3), d(2), d(4))), lambda: " ".join((d(3), d(2), d(4))), lambda: d(9),
            lambda: f"{up(2)} {d(2)} {d(2)} {d(2)} {up(1)}", lambda: f"{up(2)}{d(6)}{up(1)}",
            lambda: up(1) + d(r.choice((7, 8))), lambda: up(2) + d(r.choice((6, 7))), lambda: up(3) + d(6), lambda: d(2) + up(2) + d(5),
            lambda: f"{d(8)}-{up(1)}", lambda: d(8) + up(1), lambda: f"{up(1)}-{d(7)}-{up(1)}", lambda: f"{up(1)}{d(7)}{up(1)}",
            lambda: f"{d(2)}.{d(3)}.{d(3)}-{r.choice((up(1), d(1)))}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}",
            lambda: " ".join((d(1), d(2), d(2), d(2), d(3), d(3), d(2))), lambda: d(13), lambda: d(15), lambda: " ".join((d(1), d(2), d(2), d(2), d(3), d(3))),
            lambda: " ".join((d(2), d(3), d(3), d(3))), lambda: d(11), lambda: "/".join((d(2), d(3), d(5))), lambda: "/".join((d(3), d(3), d(5))),
            lambda: f"{up(1)}{d(1)}{up(1)}{d(r.choice((5, 6)))}", lambda: f"{up(2)}{d(7)}{up(1)}",
            lambda: up(5) + d(4) + up(1), lambda: " ".join((d(4), d(4), d(4))), lambda: "-".join((d(4), d(4), d(4))), lambda: d(12),
            lambda: " ".join(d(4) for _ in range(4)), lambda: "-".join(d(4) for _ in range(4)), lambda: d(16),
            lambda: " ".join((d(3), d(3), d(4))), lambda: " ".join((d(3), d(3), d(3), d(2))),
        )
        return self.native(r.choice(forms)(), lang)

    def other(self) -> str:
        """Numbers of orders, books, goods and the like."""
        r, d = self.r, self.digits
        forms = (
            lambda: d(r.choice((4, 5, 6, 7, 8, 9))), lambda: "-".join(d(r.choice((2, 3, 4))) for _ in range(r.choice((2, 3)))),
            lambda: "-".join((d(3), d(1), d(2), d(6), d(1))), lambda: "-".join((d(3), d(1), d(2), d(4), d(1))), lambda: "-".join((d(1), d(3), d(5), d(1))),
            lambda: f"{d(4)}/{d(4)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(3)} {d(4)} {d(4)}", lambda: f"AB-{d(4)}", lambda: f"X{d(3)}", lambda: "-".join((d(2), d(4), d(4))),
            lambda: "-".join((d(3), d(7), d(7))), lambda: f"{d(2)}.{d(2)}.{d(4)}",
        )
        return r.choice(forms)()

    def address(self, lang: str) -> str:
        r = self.r
        n = f"{r.randint(1, 300)}" + r.choice(("", "", "", "", r.choice("abc"), f"-{r.randint(1, 40)}", f"/{r.randint(1, 9)}"))
        f = self.word(lang) + (f" {self.word(lang)}" if r.random() < 0.15 else f"-{self.word(lang)}" if r.random() < 0.12 else "")
        no = r.choice(("", "", "", "No. ", "nº ", "n.º ", "N° ", "Nr. "))
        if lang == "en":
            kind = r.choice("Street St St. Road Rd Lane Ln Court Square Avenue Ave Ave. Drive Place Close Terrace Way Boulevard Crescent Row".split())
            return f"{no if no == 'No. ' else ''}{n}{r.choice((' ', ' ', ', '))}{r.choice(('', '', 'Old ', 'New ', 'East '))}{f} {kind}"
        if lang == "hi":
            return f"{r.choice(('', '', 'मकान नं. ', 'मकान संख्या ', 'नं. '))}{n}{r.choice((', ', ' '))}{f} {r.choice('मार्ग रोड गली सड़क पथ'.split())}"
        if lang == "de":
            kind = r.choice("straße str. gasse weg platz allee ufer damm ring".split())
            s = f"{f}-{kind.capitalize()}" if " " in f or r.random() < 0.1 else f + kind
            return f"{r.choice(('', '', 'Alte ', 'Neue ', 'Am '))}{s} {n}"
        if lang == "fr":
            kind = r.choice("rue avenue bd boulevard place allée chemin impasse quai cours".split())
            return f"{n}{r.choice(('', '', '', ' bis', ' ter'))}{r.choice((' ', ', '))}{kind} {r.choice(('', '', 'de ', 'du ', 'de la '))}{f}"
        kind = r.choice(("Calle C/ Plaza Avda. Avenida Paseo Camino Ronda" if lang == "es" else "Rua Travessa Av. Avenida Praça Largo Alameda Estrada").split())
        return f"{kind} {r.choice(('', '', 'de ', 'del ' if lang == 'es' else 'do '))}{f}{r.choice((' ', ', '))}{no if no[:1] == 'n' else ''}{n}"

    def email(self) -> str:
        r = self.r
        w = lambda: self.syllables().lower().translate(str.maketrans("áéíóúäöüèêãç", "aeiouaoueeac"))
        user = r.choice((f"{w()}.{w()}", f"{w()}_{w()}", f"{w()}-{w()}", f"{w()}{r.randint(1, 99)}", w(), f"{w()}+{w()}", f"{w()[0]}{w()}"))
        dom = r.choice((w(), f"{w()}-{w()}")) + "." + r.choice(("test", "example", "invalid", "com", "org", "net", "co.uk", "mail.test", "co.example"))
        at, dot = r.choice(((" @ ", "."), ("＠", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" AT ", " DOT "), (" at ", " dot "))) if r.random() < 0.4 else ("@", ".")
        out = f"{user}{at}{dom.replace('.', dot)}"
        return out.upper() if r.random() < 0.08 else out

    def filled(self, text: str, lang: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The sentence with its slots filled, and the places and kinds of the pieces."""
        r, spans = self.r, []
        kinds = {"N": ("pname", self.name), "A": ("addr", self.address), "I": ("idno", self.identity), "P": ("phone", self.phone), "E": ("email", lambda _: self.email())}
        plain = {
            "c": lambda: self.word(lang), "n": lambda: str(r.randint(2, 900)), "b": self.other, "v": lambda: f"{r.randint(1, 12)}.{r.randint(0, 30)}.{r.randint(0, 2000)}",
            "W": lambda: " ".join(self.word(lang) for _ in range(r.choice((2, 2, 3)))), "y": lambda: r.choice((str(r.randint(1900, 2030)), f"{r.randint(1990, 2010)}-{r.randint(2011, 2030)}")),
            "m": lambda: r.choice((f"{r.randint(1, 9)} {self.digits(3)},50", f"{r.randint(1, 99)}.{self.digits(3)},00", f"{r.randint(1, 99)},{self.digits(3)}")), "g": lambda: f"{r.randint(1, 89)}.{self.digits(r.randint(1, 4))} N {r.randint(1, 89)}.{self.digits(r.randint(1, 4))} E",
        }
        at = 0
        while (at := text.find("{", at)) >= 0:
            c = text[at + 1]
            v = kinds[c][1](lang) if c in kinds else plain[c]()
            if c in kinds:
                spans.append((at, at + len(v), kinds[c][0]))
            text = text[:at] + v + text[at + 3 :]
            at += len(v)
        return text, spans


def sentences(n: int, seed: int, proper: Sequence[str] = (), ordinary: Sequence[str] = (), other: Sequence[str] = (), carriers: dict | None = None) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts of one to four sentences with the places and kinds of their pieces.

    ``carriers``: kind of slot -> language -> sentences, in place of those above.
    """
    w = Writer(random.Random(seed), proper, ordinary, other)
    tables = carriers or {"N": NAMES, "A": ADDRESSES, "I": IDENTITIES, "P": PHONES, "E": EMAILS, "-": OTHERS}
    for _ in range(n):
        lang = w.r.choice(LANGS)
        joint = w.r.choice((" ", " ", "  ", "\n", "\n- ", "\n\n"))
        text, spans = w.r.choice(("", "", "- ", "<p>", "* ")), []
        for k in range(w.r.choice((1, 2, 2, 3, 4))):
            kind = w.r.choices("NAIPE-", (26, 12, 14, 14, 8, 40))[0]
            # captions of numbers and addresses are met in texts of any language
            own = w.r.choice(LANGS) if kind in "PE" and w.r.random() < 0.2 else lang
            part, found = w.filled(w.r.choice(tables[kind][own].split("|")), own)
            # without capitals only the words around tell a name: such texts need more sentences without one
            if kind == "-" and w.r.random() < (0.75 if lang == "hi" else 0.35):
                part = w.noise(lang)
            if kind == "-" and w.r.random() < 0.15:
                part = part.upper()
            if k:
                text += joint
            spans += [(a + len(text), b + len(text), x) for a, b, x in found]
            text += part
        yield text, spans
