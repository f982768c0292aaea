"""Function words: articles, pronouns, prepositions, conjunctions and auxiliaries that carry no concept.

Own list, by language and in alphabetical order, after common stop-word lists. Operators take it as a parameter.
"""

_BY_LANGUAGE = {
    "en": "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does down during "
    "each every few for from had has have he her here him his how i if in into is it its just me more most my no nor not of off on once one only or other our out "
    "over own per same she should so some such than that the their them then there these they this those through to too two under until up upon very via was we "
    "were what when where which while who whom why will with would you your",
    "es": "al algo ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era es esa ese eso esta estas este esto estos está "
    "están fue ha hasta hay la las le les lo los me mi más muy ni no nos o otra otro para pero por porque que quien se ser si sin sobre son su sus también te toda "
    "todas todo todos tu un una unas uno unos y ya yo",
    "fr": "à au aussi aux avec ce ces cet cette ceux chez comme dans de des donc du elle elles en entre est et eux il ils je la le les leur leurs lui ma mais me mes "
    "moi mon même ne nos notre nous on ont ou où par pas pour qu que quel quelle qui sa sans se ses si son sont sur ta te tes toi ton tu un une vers vos votre vous y",
    "de": "aber als am an auch auf aus bei bin bis da das dass dem den der des die dies diese du durch ein eine einem einen einer eines er es euch für gegen hat ich ihm ihn "
    "ihr im in ist ja kein keine man mein mit nach nicht noch nur oder ohne sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu "
    "zum zur",
    "pt": "a ao aos as até com como da das de dela dele do dos e ela elas ele eles em entre era essa esse esta está este eu foi há isso isto já lhe mais mas me mesmo "
    "meu minha muito na nas nem no nos não o os ou para pela pelo por qual quando que quem se sem ser seu sua são também te tem um uma umas uns você",
    "hi": "अपना अपनी अपने अब इस इसके उनके उस उसके एक ऐसे और कर करने का कि की कुछ के को कोई क्या गया जब जो तक तो था थी थे दो द्वारा न नहीं ने पर फिर बहुत भी में यह यहाँ या ये रहा "
    "रही रहे लिए वह वाले वे से साथ ही हुआ हुई हुए हूँ हैं है हो होता",
    "ar": "إلا إلى أن أو أي التي الذي أنا بعد بين ثم حتى ذلك عن عند على غير في قبل قد كان كانت كل كما لا لم لن ما مع من منذ نحن هذا هذه هل هم هنا هو هي و",
}

FUNCTION_WORDS = list(dict.fromkeys(w for words in _BY_LANGUAGE.values() for w in words.split()))
