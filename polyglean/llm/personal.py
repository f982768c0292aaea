"""Problem 8: personal information in free text, found by a semi-Markov conditional random field.

Candidate segments of each kind come from permissive patterns, all sub-spans with sensible ends included. Features
describe a whole segment (groups of a number, form of a name, parts of an address), what kind of word each token is
(ordinary, proper, form of address, initial, unknown; from the vocabulary of public tokenizers, no list of names) and
the words around it, by themselves and by the kind of cue they give. A dynamic program over the ends of segments picks
the best set of non-overlapping typed segments; text outside of them is a run of unit segments of weight zero. Weights
are trained on sentences written from ``personal_training`` by the gradient of the exact conditional likelihood
(forward-backward over the candidate lattice, AdaGrad), with the words around dropped at random so that the model does
not lean on the sentences it was trained on.

Segments are bounded, as the method needs: names have two to ``NAME_TOKENS`` tokens, numbers up to ``NUMBER_GROUPS``
groups with ``DIGITS`` digits. A longer run of capitalized words or groups of digits is searched whole, by all its parts
of such lengths.

Characters without width are looked through: a piece is found as if they were absent and reported as it stands. Texts
are handled whole; NULL and empty ones have no piece. Repeated rows each get their own pieces.
"""

from __future__ import annotations

import base64
import math
import os
import unicodedata
import warnings
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from polyglean.functions.words import FUNCTION_WORDS
from polyglean.llm.personal_training import sentences
from polyglean.runtime import spread

#: Vocabularies of public tokenizers, read by the driver: where a word stands in them tells ordinary from proper words.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Bounds of the candidate segments.
NAME_TOKENS, NUMBER_GROUPS, DIGITS = 5, 8, (4, 20)

KINDS = ("email", "phone", "idno", "addr", "pname")

# Words for kinds of streets.
STREET_AFTER = r"Street|St|Road|Rd|Lane|Ln|Court|Ct|Square|Sq|Avenue|Ave|Drive|Dr|Place|Pl|Close|Terrace|Way|Boulevard|Blvd|Crescent|Row|मार्ग|रोड|गली|सड़क|पथ"
STREET_BEFORE = r"rue|avenue|av|bd|boulevard|place|allée|chemin|impasse|quai|cours|square|route|Calle|C/|Plaza|Pza|Avda|Avenida|Paseo|Camino|Ronda|Rua|Travessa|Av|Praça|Largo|Alameda|Estrada"
STREET_JOINED = r"straße|strasse|str|gasse|weg|platz|allee|ufer|damm|ring"

# Forms of address, which are no part of a name.
HONORIFICS = frozenset(
    "dr dra prof mr mrs ms miss mx sir madam rev sr sra srta senor senora senorita don dona doctor doctora doutor doutora mme mlle m "
    "monsieur madame mademoiselle herr frau fraulein hr fr senhor senhora श्री श्रीमती कुमारी सुश्री डॉ डॉक्टर प्रो पंडित जी".split()
)
# What a word says of a number or name near it.
CUES = {
    "phone": "phone telephone tel mobile cell fax call ring dial whatsapp sms hotline ext telefono telefone movil telemovel celular llame llamenos llamar "
    "appelez appeler portable gsm joindre telefon handy rufnummer rufen anrufen durchwahl mobil ligue ligar liga contacto फ़ोन फोन मोबाइल दूरभाष कॉल नंबर",
    "id": "id ssn nhs passport passports licence license identity social insurance tax taxpayer card visa mastercard dni nie nif pasaporte identidad "
    "documento tarjeta seguridad fiscal passeport identite securite carte assurance bancaire ausweis personalausweis reisepass steuernummer steuer "
    "versicherungsnummer ausweisnummer kreditkarte cpf rg passaporte identidade cartao cidadao contribuinte पासपोर्ट पहचान आधार पैन बीमा कार्ड कर",
    "goods": "order orders invoice isbn item lot batch version model serial tracking reference ref page part parts iban account copy copies factura pedido lote "
    "jar jars box boxes shelf crate crates bottle bottles articulo referencia pagina facture commande article page reference rechnung bestellung artikel seite posten ware fatura encomenda artigo "
    "बिल ऑर्डर अंक पन्ना पृष्ठ संस्करण क़ीमत पुस्तक",
    "place": "in at near to from towards into en cerca hacia a près vers nach bei bis aus em perto para street road bridge river city town market lake castle park "
    "calle puente rio ciudad mercado rue pont ville marche brücke stadt fluss rua ponte cidade में मार्ग पुल शहर गाँव",
    "firm": "hotel cafe bar club company team shop brand band orchestra museum school bakery restaurant the el la le der das verein gasthaus maison casa "
    "tienda boutique laden loja clube दुकान कंपनी",
    "person": "name names author photo picture image by signed interview friend sister brother mother father aunt uncle neighbour neighbor teacher dear hello hi "
    "i'm am contact thanks thank ask asked met regards sincerely wishes cheers love nombre autor autora foto imagen firmado entrevista amiga amigo hermano "
    "hermana soy llamo querida querido saludos saludo atentamente pregunte nom auteur signe amie ami frere soeur suis appelle m'appelle cher chere "
    "cordialement amities demandez contactez procure procurar pergunte perguntar preguntar pregunten autorin fragen frage kontaktieren bild freundin freund bruder schwester bin heisse heiße liebe lieber grüße grussen grüßen herzlich nome "
    "imagem assinado amigo irmao irma sou chamo-me chamo cumprimentos abracos atenciosamente लेखक नाम चित्र तस्वीर भवदीय धन्यवाद प्रिय सादर मित्र भाई बहन",
    "time": "yesterday today tomorrow morning evening afternoon week ayer hoy mañana tarde semana hier aujourd'hui demain matin soir semaine gestern heute morgen "
    "abend woche ontem hoje amanhã manhã noite कल आज परसों सुबह शाम रात हफ़्ते",
    "speech": "said says wrote told asked asks thinks told likes gave won retired dijo escribió escribio dice dit ecrit a sagte schrieb meint disse escreveu diz ने",
    "no": "no nr n nº n.º num number numero numéro número nummer संख्या नं",
}
# Ordinary words that a vocabulary of mostly English words lacks.
ORDINARY = (
    "a again all although always an another any anyone anything are because been being but did do does down each else even ever every everyone few had has have he "
    "her his how however i if in into is it its just let many maybe me might most must my neither never no nobody none nor not nothing now of off often on once only "
    "or other others our out over perhaps quite rather read same shall she should since so some somebody someone something soon still such than that the their them "
    "then there these they this those though through to today too under unless until up upon us very was we were what when where whether which while who whom whose "
    "why with within without would yes yesterday yet you your "
    "aber alle als also am andere auch beim bin bis da damit dann dass dein deine deren dessen diese diesem diesen dieser dieses doch dort durch ehe euch euer "
    "früher ganz gegen gestern gibt guten haben hat heute hier hinter ihm ihn ihr ihre im immer in ist jede jeden jeder jedes jene jener kann kein keine leider man "
    "manche mehr mein meine mit morgen neben neue nichts niemand noch nun nur ob oben oder ohne schon sehr sein seine seit sie sogar solche über um unser "
    "unsere unten unter viel viele vom vor wann warum was weil welche wenn wer wie wieder wir wo wohl zwischen kinder leute frauen männer bücher häuser "
    "ahora algo alguien algunos antes aquí ayer cada casi como cuando después donde durante ella ellos entonces eso esos estas estos hace hoy luego mañana mientras "
    "mucho muchos nada nadie nunca otra otro otros poco porque primero quien según siempre tal también tan tiene tres tu un ya yo alors après aujourd'hui aucun "
    "autre avant bien car ce ceci cela celui chaque chez comme comment demain depuis deux dire donc encore enfin ensuite entre et faire hier ici il jamais je là "
    "leur lorsque lui même moins mon notre on ou personne peu plus plusieurs pourquoi première puis quand quel quelques rien si sous souvent sur tous toute très "
    "trop un vers voici voilà votre agora ainda além algum algumas amanhã antes aqui assim até cada com contudo depois desde ela ele eles então era essa este eu "
    "foi hoje isso isto já lá mas menos meu minha muito muitas muitos nada não nenhum ninguém nossa nosso nunca o onde ontem os ou outra outro para pela pelo "
    "porém pouco quando que quem sempre seu sua também tem toda todos tudo um você "
    "अगर अपना अपनी अपने अब अभी आज आप आया आई आए इतना इन इस इसका इसकी इसके इसमें इसलिए उन उनका उनकी उनके उस उसका उसकी उसके उसने उसे एवं ऐसा ऐसी ऐसे और कई कब कभी कम "
    "करता करती करते करना करने कल कहा कहाँ का काम किंतु किया किसी कुछ कैसे कोई कौन क्या क्यों क्योंकि गई गए गया घर चाहिए जब जबकि जहाँ जा जाता जाती जाते जाना जैसे जो ठीक "
    "तक तब तरह तुम तेरा था थी थे थोड़ा दिन दिया दूर दे देखा दो दोनों नई नए नया नहीं नीचे पर परंतु पहले पास फिर बड़ा बड़ी बड़े बहुत बात बाद बाहर बिना बीच भर भी मगर मन मत माँ "
    "मिला मुझे मेरा मेरी मेरे मैं मैंने यदि यहाँ या ये यह यहाँ रहता रहती रहते रहा रही रहे लिए लिया ले लेकर लेकिन लोग लोगों वह वहाँ वही वाला वाली वाले वे वैसे शाम शायद सकता सकती सकते "
    "सब सबको सबसे सभी समय साथ सामने साल सिर्फ़ सुबह से हम हमने हमारा हमारी हमारे हमें हर हालाँकि ही हुआ हुई हुए हूँ हैं है हो होकर होगा होगी होता होती होते होना "
    "दौरान हफ़्ते हफ़्ता महीने महीना सप्ताह घंटे मिनट छुट्टी छुट्टियों सच कहें कहते बोले बताया सुना समझ विषय बारे ओर तरफ़ अंदर ऊपर आगे पीछे सीधे धीरे जल्दी देर रात दोपहर सुबह दिन "
    "शहर गाँव देश दुनिया सड़क नदी पहाड़ पेड़ फूल पानी दूध चाय कॉफ़ी रोटी चावल दाल सब्ज़ी खाना खाने नमक चीनी मिठाई बाज़ार दुकान पैसा पैसे रुपये क़ीमत सस्ता महँगा बगीचा बाग किताब कहानी "
    "गीत संगीत खेल स्कूल शिक्षक छात्र बच्चा बच्चे बच्चों लड़का लड़की आदमी औरत परिवार पिता माता दादी दादा दोस्त कुत्ता बिल्ली गाय घोड़ा गाड़ी यात्रा रास्ता ट्रेन फ़ोन मोबाइल कंप्यूटर दवा डॉक्टर "
    "तैयार नहीं पुराना पुरानी पुराने छोटा छोटी छोटे अच्छा अच्छी अच्छे सुंदर मीठा ताज़ा लंबा ऊँचा गरम ठंडा आसान मुश्किल मशहूर आधुनिक पसंद ज़रूरत मदद मेहमान मेहमानों त्योहार "
    "सकें लगते लगता लगती लगा मिलता मिलती मिलते मिल बना बनाया बनाने चुना खुला बंद लौटा लौट रखा रखी रखे रख पढ़ा लिखा लिखी देखे देखना सुनकर चल चलते बैठे "
    "आणि आम्ही आहे आहेत एक कारण काही किंवा की केला केली खूप गेला घरी छोटा तर तरी तिथे ती तुम्ही ते तेथे तो त्या त्याने नाही नंतर पण परत पाऊस मध्ये मला माझा मी म्हणून या येथे येथील "
    "बद्दल तुम्हाला घेऊन हून प्रकारचे पाहिले निवडले मिळते माहीत नव्हते कोणालाही बोलतात पूरी पूरा सूची आवश्यक विना विषये अतीव कुत्र स्थाने जनाः वदन्ति कः यत् वयं एव किम् कथम् यदा तदा "
    "लहान लोक साठी सर्व सुंदर हा ही हे होता होती होते अहम् अस्ति अत्र अपि इति एतत् च तत् तत्र न भवति सः सा सन्ति"
).split()

_CAP = r"\p{Lu}[\p{L}\p{M}'’]*(?:-\p{Lu}[\p{L}\p{M}'’]*)*"
_NAME = rf"(?:{_CAP}|[\p{{Deva}}]+(?:-[\p{{Deva}}]+)*)"
_HOUSE = r"\d{1,5}(?:[a-zA-Z](?![\p{L}\p{M}]))?(?:[-/]\d{1,4})?"
_NO = r"(?:(?:No|Nr|nº|n\.º|n°|N°|núm|मकान\s+नं|मकान\s+संख्या|नं)\.?\s*)"

EMAIL = regex.compile(
    r"(?<![\p{L}\p{N}._%+\-])(?P<u>[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+)"
    r"(?P<at>\s?[@＠]\s?|\s?[(\[{]\s?(?:at|AT|At)\s?[)\]}]\s?|\s(?:at|AT)\s)"
    r"(?P<d>[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
    r"(?:(?:[.．]|\s?[(\[{]\s?(?:dot|DOT|Dot)\s?[)\]}]\s?|\s(?:dot|DOT)\s)[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?)+)"
    r"(?![\p{L}\p{N}])"
)
AT = regex.compile(r"[@＠]|[(\[{]\s?(?:at|AT|At)\s?[)\]}]|\s(?:at|AT)\s")
BLANK = regex.compile(r"(?r)\s")
_GROUP = r"(?:[A-Z]{0,5}\d+[A-Z]{0,5}(?:\d+[A-Z]{0,3})*|(?<=[\d][ \-])[A-Z](?![\p{L}])|(?<![\p{L}\p{N}])[A-Z]{1,3}(?=[ \-]\d))"
RUN = regex.compile(rf"(?<![\p{{L}}\p{{N}}@_])[+＋]?\(?{_GROUP}(?:(?:\)[ \-]?|[ \xa0]?\(|[ \xa0.\-/‑–])\(?{_GROUP})*\)?(?![\p{{L}}\p{{M}}\p{{N}}@])")
GROUP = regex.compile(r"[A-Z0-9\p{Nd}]+")
ADDRESS = {
    "after": regex.compile(rf"(?P<no>{_NO})?(?P<house>{_HOUSE}),?\s(?P<name>{_NAME}(?:\s{_NAME}){{0,3}}?)\s(?P<type>{STREET_AFTER})(?![\p{{L}}\p{{M}}])(?P<dot>\.)?"),
    "before": regex.compile(rf"(?P<no>{_NO})?(?P<house>{_HOUSE})(?:\s(?:bis|ter|quater))?,?\s(?P<type>(?i:{STREET_BEFORE}))\.?\s(?:(?:de|du|des)\s(?:la\s|l['’])?|d['’])?(?P<name>{_CAP}(?:\s{_CAP}){{0,3}})"),
    "number": regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?P<type>(?i:{STREET_BEFORE}))\.?\s?(?:(?:de|del|da|do|dos|das)\s(?:la\s|las\s|los\s)?)?(?P<name>{_CAP}(?:\s{_CAP}){{0,3}}),?\s{_NO}?(?P<house>{_HOUSE})(?![\p{{L}}\p{{M}}\p{{N}}])"),
    "joined": regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?P<name>(?:(?:Alte|Alter|Neue|Neuer|Große|Kleine|Am|An\sder)\s)?\p{{Lu}}[\p{{L}}\-]*?)(?P<type>{STREET_JOINED})\.?\s(?P<house>{_HOUSE})(?![\p{{L}}\p{{M}}\p{{N}}])"),
}
NAME_RUN = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}@._+\-])(?:{_CAP}\.?|[\p{{Deva}}]+(?:-[\p{{Deva}}]+)*)(?:,?[ \xa0](?:{_CAP}(?:\.(?=[ ,]))?|[\p{{Deva}}]+(?:-[\p{{Deva}}]+)*))*(?![\p{{L}}\p{{M}}\p{{N}}@_])")
NAME_TOKEN = regex.compile(r"[^\s,]+")
WORD = regex.compile(r"[\p{L}\p{M}]+|\d+|[^\s\p{L}\p{M}\d]")
DEVANAGARI = regex.compile(r"\p{Deva}")
WIDTHLESS = regex.compile(r"\p{Cf}")
INITIAL = regex.compile(r"\p{Lu}\.?")
RUNS = regex.compile(r"[A-Z]+|\d+|[^A-Z\d]")
_ALIKE = str.maketrans({"\xa0": " ", "‑": "-", "–": "-", "＋": "+"})

Segment = tuple[int, int, str, list[str]]


@lru_cache(200_000)
def _fold(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w.casefold()) if not unicodedata.combining(c) or c > "ऀ")


@cache
def vocabulary(paths: tuple[str, ...] = VOCABULARIES) -> tuple[frozenset[str], frozenset[str]]:
    """(ordinary, proper): words that start a token in lower case, and those that do so capitalized only; both folded.

    A file that is not there is told of and left out: fewer words are then known as ordinary or proper.
    """
    lower, upper = set(), set()
    for path in paths:
        if not os.path.exists(path):
            warnings.warn(f"no vocabulary at {path}", stacklevel=2)
            continue
        with open(path, "rb") as f:
            for line in f:
                token = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
                w = token[1:]
                if token[:1] == " " and len(w) > 2 and w.isalpha():
                    (lower if w.islower() else upper).add(w)
    ordinary = frozenset(map(_fold, (*FUNCTION_WORDS, *ORDINARY, *lower)))
    return ordinary, frozenset(x for w in upper if w[1:].islower() and (x := _fold(w)) not in ordinary)


_CUE = {_fold(w): c for c, ws in CUES.items() for w in ws.split()}


class Words:
    """What kind of word a token is: H form of address, I initial, S of the sentence, W ordinary, P proper, F unknown."""

    def __init__(self, ordinary: frozenset[str], proper: frozenset[str]):
        self.ordinary, self.proper = ordinary, proper
        self.sentence = frozenset(map(_fold, (*FUNCTION_WORDS, *ORDINARY)))
        self._kinds: dict[str, str] = {}

    def kind(self, t: str) -> str:
        k = self._kinds.get(t)
        if k is None:
            w = _fold(t.rstrip("."))
            k = (
                "I" if INITIAL.fullmatch(t) else "H" if w in HONORIFICS else "S" if w in self.sentence else "W" if w in self.ordinary
                else "P" if w in self.proper else "F"
            )
            if len(self._kinds) > 200_000:
                self._kinds.clear()
            self._kinds[t] = k
        return k


def _before(text: str, a: int) -> list[str]:
    """Words before a segment: themselves (r:, dropped at random in training) and the cues they give."""
    words = WORD.findall(text[max(0, a - 60) : a])
    if a > 60:
        words = words[1:]  # it may be cut
    sign = words[-1] if words and not words[-1][0].isalnum() else ""
    bw = [_fold(w) for w in words if w[0].isalpha()][-4:]
    near = [_CUE.get(w, "-") for w in bw]
    out = [f"b={sign or ('0' if words and words[-1][0].isdecimal() else 'w' if words else '^')}", f"r:bw={bw[-1] if bw else '^'}", f"r:bw2={' '.join(bw[-2:])}", f"c1={near[-1] if near else '^'}"]
    out += {f"c={c}" for c in near[-3:] if c != "-"}
    last = next((c for c in reversed(near) if c not in ("-", "no", "place", "firm", "time")), "-")
    out += [f"cue={last}", f"cue={last}{sign}"]
    line = a == 0 or text[a - 1] == "\n" or text[max(0, a - 3) : a] in ("\n- ", "\n* ") or a <= 3 and not text[:a].strip("-* <p>")
    out.append(f"line={line}{near[-1] if near else '^'}")
    return out


def _after(text: str, b: int) -> list[str]:
    nxt = WORD.findall(text[b : b + 24])
    sign = nxt[0] if nxt and not nxt[0][0].isalnum() else ""
    words = [_fold(w) for w in nxt if w[0].isalpha()]
    aw = words[0] if words else "$"
    end = b == len(text) or text[b] == "\n"
    return [f"a={sign or ('0' if nxt and nxt[0][0].isdecimal() else 'w' if nxt else '$')}", f"r:aw={aw}", f"ac={_CUE.get(aw, '-')}", *{f"ax={c}" for w in words[1:] if (c := _CUE.get(w))}, f"end={end}"]


def _number(text: str, a: int, b: int, groups: int) -> list[str]:
    s = text[a:b].translate(_ALIKE)
    parts = RUNS.findall(s)
    shape = "".join(f"{'A' if p[0].isalpha() else 'D'}{len(p)}" if p.isalnum() else p for p in parts)
    digits = sum(c.isdigit() for c in s)
    lead = "00" if s[:2] in ("00", "००") else s[0] if s[0] in "+(0०" else "A" if s[0].isalpha() else "9"
    signs = "".join(sorted(set(shape) & set(" -./()+")))
    alpha = "A" in shape
    return [f"s={shape}", f"d={digits}{alpha}", f"lead={lead}", f"lead={lead}{digits}", f"signs={signs}", f"g={groups}", f"ls={lead}{signs}{alpha}", f"alpha={alpha}"]


def _emails(text: str) -> Iterator:
    """Matches of ``EMAIL`` from left to right, sought only around what may stand for an at sign."""
    done = 0
    for at in AT.finditer(text, overlapped=True):
        if at.start() < done:
            continue
        end = at.start() - text[at.start() - 1 : at.start()].isspace()
        blank = BLANK.search(text, 0, end)  # the local part holds none
        m = EMAIL.search(text, max(done, blank.end() if blank else 0), len(text)) if at.start() else None
        if m and m.start() < at.start():
            yield m
            done = m.end()


def candidates(text: str, words: Words) -> list[Segment]:
    """All candidate segments (begin, end, kind, features) of a text without zero-width characters."""
    out: list[Segment] = []
    for m in _emails(text):
        at, dom = m.group("at"), m.group("d")
        mark = "@" if "@" in at or "＠" in at else "(" if regex.search(r"[(\[{]", at) else "word"
        spaced = "_" if at != at.strip() else ""
        dots = "word" if regex.search(r"\s(?:dot|DOT)\s", dom) else "(" if regex.search(r"[(\[{]", dom) else "."
        out.append((m.start(), m.end(), "email", [f"at={mark}{spaced}", f"dot={dots}", f"atdot={mark}{spaced}{dots}"]))
    for m in RUN.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in GROUP.finditer(m.group())]
        before, after = {}, {}
        for i in range(len(groups)):
            for j in range(i, min(len(groups), i + NUMBER_GROUPS)):
                a, b = groups[i][0], groups[j][1]
                if text[a - 1 : a] == "(" and ")" in text[a:b]:
                    a -= 1
                if i == 0 and text[a - 1 : a] in ("+", "＋"):
                    a -= 1
                digits = sum(c.isdigit() for c in text[a:b])
                if not DIGITS[0] <= digits <= DIGITS[1] or text.count("(", a, b) != text.count(")", a, b):
                    continue
                if a not in before:
                    before[a] = _before(text, a)
                if b not in after:
                    after[b] = _after(text, b)
                first = text[groups[i][0] : groups[i][1]]
                f = [*_number(text, a, b, j - i + 1), *before[a], *after[b]]
                shape = f[0]
                f += [f"{x}|{shape}" for x in before[a] if x.startswith("cue=")]
                f += [f"cut={i > 0}{j < len(groups) - 1}", f"cutl={i > 0}{text[a - 1 : a]}", f"cutr={j < len(groups) - 1}{text[b : b + 1]}"]
                if first.isalpha():
                    f.append(f"caption={_CUE.get(_fold(first), '-')}")
                if text[a - 1 : a] == "(" and text[b : b + 1] == ")":
                    f.append("inside")
                out.append((a, b, "phone", f))
                out.append((a, b, "idno", f))
    for kind, p in ADDRESS.items():
        for m in p.finditer(text, overlapped=kind in ("after", "before")):
            t = m.group("type").lower()
            names = m.group("name").split()
            forms = "".join(words.kind(x) for x in names)
            f = [f"p={kind}", f"t={kind}:{t}", f"n={len(names)}", f"form={forms}", *_before(text, m.start()), *_after(text, m.end())]
            starts = {m.start(): "all"}
            if m.groupdict().get("no"):
                starts[m.start("house")] = "no-cut"
            ends = {m.end(): "all"}
            if m.groupdict().get("dot"):
                ends[m.end() - 1] = "dot-cut"
                f = [*f, f"dot={t}", f"dotnext={text[m.end() : m.end() + 1].isspace()}"]
            if kind == "before":
                for k, w in enumerate(regex.finditer(r"\s", m.group("name")), 1):
                    ends[m.start("name") + w.start()] = f"name-cut{forms[k]}"
            if regex.match(r"[-/]?\d", text[m.end() : m.end() + 2]) or text[m.start() - 1 : m.start()].isdigit() or regex.match(r"[\d][-/.,]", text[max(0, m.start() - 2) : m.start()]):
                f.append("inside-number")
            for a, x in starts.items():
                for b, y in ends.items():
                    out.append((a, b, "addr", [*f, f"x={x}", f"y={y}{t if y == 'dot-cut' else ''}"]))
    for m in NAME_RUN.finditer(text):
        toks = [(m.start() + t.start(), m.start() + t.end()) for t in NAME_TOKEN.finditer(m.group())]
        kinds = [words.kind(text[a:b]) for a, b in toks]
        stops = [text[b - 1] == "." and k not in "IH" for (_, b), k in zip(toks, kinds)]  # a sentence ends there
        upper = [k != "I" and text[a:b].isupper() for (a, b), k in zip(toks, kinds)]
        deva = DEVANAGARI.match(text[toks[0][0]]) is not None
        before, after = {}, {}
        for i in range(len(toks)):
            if kinds[i] in "HS" or text[toks[i][0] : toks[i][1]] == "M.":
                continue
            for j in range(i + 1, min(len(toks), i + NAME_TOKENS)):
                if stops[j - 1] or kinds[j] == "H" or deva and kinds[j] == "S":
                    break  # a name has no form of address inside
                if kinds[j] == "S" or kinds[j] == "I" and text[toks[j][1] - 1] != ".":
                    continue
                a, b = toks[i][0], toks[j][1]
                if text[b - 1] == "." and kinds[j] != "I":
                    b -= 1
                if i not in before:
                    before[i] = _before(text, a)
                if b not in after:
                    after[b] = _after(text, b)
                form = "".join(("," if text[toks[k][0] - 2] == "," else "") * (k > i) + kinds[k] for k in range(i, j + 1))
                form = f"d{form}" if deva else form
                left = "^" if i == 0 else ("," if text[toks[i][0] - 2] == "," else "") + kinds[i - 1]
                right = "$" if j == len(toks) - 1 else ("," if text[b : b + 1] == "," else "") + kinds[j + 1]
                caps = "upper" if not deva and text[a:b].isupper() else "mixed"
                near = [*before[i], *after[b]]
                f = [f"form={form}", f"form={form}|{left}", f"form={form}>{right}", f"left={left}", f"right={right}", f"edge={left}{right}", caps, f"caps={caps}{form}", f"len={j - i}", *near]
                f += [f"first={_CUE.get(_fold(text[a : toks[i][1]]), '-')}", f"last={_CUE.get(_fold(text[toks[j][0] : b]), '-')}"]
                f.append(f"shout={caps}{i > 0 and upper[i - 1] or j + 1 < len(toks) and upper[j + 1]}")
                f.append(f"{before[i][-1]}{before[i][0]}{after[b][-1]}|{form}")
                f += [f"{x}|{form}" for x in near if x[:4] in ("cue=", "line", "end=") or x[:3] in ("ac=", "c1=")]
                out.append((a, b, "pname", f))
    return out


class SemiCRF:
    def __init__(self):
        self.w: dict[str, dict[str, float]] = {k: {} for k in KINDS}

    def score(self, kind: str, feats: list[str]) -> float:
        get = self.w[kind].get
        out = get("", 0.0)
        for f in feats:
            out += get(f, 0.0)
        return out

    @staticmethod
    def _order(cands: list[Segment]) -> tuple[list[int], dict[int, int], list[list[int]]]:
        ends = sorted({p for a, b, _, _ in cands for p in (a, b)})
        at = {p: k for k, p in enumerate(ends)}
        into: list[list[int]] = [[] for _ in ends]
        for n, c in enumerate(cands):
            into[at[c[1]]].append(n)
        return ends, at, into

    def best(self, cands: list[Segment]) -> list[Segment]:
        """Viterbi: the highest-scoring set of non-overlapping segments."""
        if not cands:
            return []
        scores = [self.score(c[2], c[3]) for c in cands]
        ends, at, into = self._order(cands)
        value, choice = [0.0] * len(ends), [-1] * len(ends)
        for k in range(1, len(ends)):
            value[k] = value[k - 1]
            for n in into[k]:
                v = value[at[cands[n][0]]] + scores[n]
                if v > value[k] + 1e-12:
                    value[k], choice[k] = v, n
        out, k = [], len(ends) - 1
        while k > 0:
            if choice[k] < 0:
                k -= 1
            else:
                out.append(cands[choice[k]])
                k = at[cands[choice[k]][0]]
        return out[::-1]

    def marginals(self, cands: list[Segment]) -> list[float]:
        """Probability of each candidate under the model, by forward-backward over the lattice."""
        scores = [self.score(c[2], c[3]) for c in cands]
        ends, at, into = self._order(cands)
        n_ends = len(ends)
        alpha, beta = [0.0] * n_ends, [-math.inf] * n_ends
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf else y
        for k in range(1, n_ends):
            alpha[k] = alpha[k - 1]
            for n in into[k]:
                alpha[k] = add(alpha[k], alpha[at[cands[n][0]]] + scores[n])
        beta[-1] = 0.0
        for k in range(n_ends - 1, 0, -1):
            beta[k - 1] = add(beta[k - 1], beta[k])
            for n in into[k]:
                s = at[cands[n][0]]
                beta[s] = add(beta[s], beta[k] + scores[n])
        z = alpha[-1]
        return [math.exp(min(0.0, alpha[at[c[0]]] + scores[n] + beta[at[c[1]]] - z)) for n, c in enumerate(cands)]

    def fit(self, data: list[tuple[list[Segment], set]], epochs: int = 5, rate: float = 0.25, l2: float = 1e-4, drop: float = 0.5) -> None:
        """``drop``: share of the sentences, drawn anew each time, that are seen without the words around the segments."""
        sums: dict[str, dict[str, float]] = {k: defaultdict(float) for k in KINDS}
        rng = np.random.default_rng(3)
        for e in range(epochs):
            for k in rng.permutation(len(data)):
                cands, gold = data[k]
                if rng.random() < drop:
                    cands = [(a, b, kind, [f for f in fs if f[:2] != "r:"]) for a, b, kind, fs in cands]
                for c, p in zip(cands, self.marginals(cands)):
                    g = float(c[:3] in gold) - p
                    if abs(g) < 1e-4:
                        continue
                    w, s = self.w[c[2]], sums[c[2]]
                    for f in ("", *c[3]):
                        old = w.get(f, 0.0)
                        d = g - l2 * old
                        s[f] += d * d
                        w[f] = old + rate * (1 - e / (epochs + 1)) * d / math.sqrt(s[f] + 1e-2)


@cache
def train(n: int = 12000, seed: int = 5, paths: tuple[str, ...] = VOCABULARIES) -> tuple[SemiCRF, Words]:
    """Fit on ``n`` written sentences; once a process."""
    ordinary, proper = vocabulary(paths)
    words, data = Words(ordinary, proper), []
    known = sorted({*FUNCTION_WORDS, *ORDINARY})
    plain = sorted(ordinary - words.sentence)
    for text, spans in sentences(n, seed, sorted(w.capitalize() for w in proper), known, plain):
        if cands := candidates(text, words):
            data.append((cands, set(spans)))
    model = SemiCRF()
    model.fit(data)
    return model, words


def find(model: tuple[SemiCRF, Words], text: str | None) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the pieces, as positions in the text as it stands."""
    if not text:
        return []
    crf, words = model
    if WIDTHLESS.search(text):
        keep = [k for k, c in enumerate(text) if not WIDTHLESS.match(c)]
        view = "".join(text[k] for k in keep)
        return [(keep[a], keep[b - 1] + 1, kind) for a, b, kind, _ in crf.best(candidates(view, words))]
    return [(a, b, kind) for a, b, kind, _ in crf.best(candidates(text, words))]


def _pieces(documents: DataFrame, schema: str, make) -> DataFrame:
    model = documents.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for d, t in zip(pdf["doc_id"], pdf["text"]) for r in make(d, t, find(model.value, t))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return spread(documents.select("doc_id", "text")).mapInPandas(run, schema)


def personal(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, found, begin, end): every piece, found as it stands, with its place (in code points)."""
    return _pieces(
        documents, "doc_id BIGINT, kind STRING, found STRING, begin INT, end INT",
        lambda d, t, ps: [(d, kind, t[a:b], a, b) for a, b, kind in ps],
    )


def redact(documents: DataFrame) -> DataFrame:
    """(doc_id, text, pieces): the text with a placeholder such as [EMAIL] for each piece; NULL stays NULL."""

    def replaced(d: int, t: str | None, ps: list[tuple[int, int, str]]) -> list[tuple]:
        if t is None:
            return [(d, None, 0)]
        out, at = [], 0
        for a, b, kind in ps:
            out += [t[at:a], f"[{kind.upper()}]"]
            at = b
        return [(d, "".join(out) + t[at:], len(ps))]

    return _pieces(documents, "doc_id BIGINT, text STRING, pieces INT", replaced)


def distinct_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "kind", "found").distinct()
