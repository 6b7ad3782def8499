"""Word lists, tables and patterns that results depend on, each whole and in its natural order."""

from __future__ import annotations

# Short words that are not said twice on purpose.
STUTTER_WORDS = "the|a|an|to|of|and|i|is|it|in|we|you|so|but|or|this|og|det|er|jeg|du|vi|at|en|et|je|le|les|un|une|ich|und|ein|el|los|y|yo|che|il|ma"

# Named character references; numeric ones follow from their number.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "ndash": "–", "mdash": "—", "hellip": "…",
    "aelig": "æ", "oslash": "ø", "aring": "å", "AElig": "Æ", "Oslash": "Ø", "Aring": "Å", "eacute": "é", "egrave": "è", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß",
    "copy": "©", "reg": "®", "trade": "™",
}

# Tags that stand inside words and sentences.
INLINE_TAGS = "a|b|i|u|em|strong|span|small|sup|sub|code|mark|font"

# How letters sound alike, in the order in which the rules apply.
SOUNDS = (("ph", "f"), ("ck", "k"), ("c(?=[eiy])", "s"), ("[cq]", "k"), ("x", "ks"), ("z", "s"), ("y", "i"), ("(?<=[^aeiou])h", ""), (r"([a-z])\1+", "$1"))

# Credits that speech models invent in silence, by language; a short credit may follow, no further sentence.
CREDITS = (
    "teksting av", "tekstet av", "undertekst(er)? av", "danske tekster", "tekster af", "tekstning af",
    "subtitles by", "thanks? (you )?for watching", "takk for at du så på", "tak fordi du så med",
    "sous-titres? (?:réalisés |fait )?par", "sous-titrage", "merci d'avoir regardé",
    "untertitel (?:im auftrag|von|der)", "untertitelung", "vielen dank fürs zuschauen",
    "subtítulos (?:realizados |hechos )?por", "gracias por ver",
    "sottotitoli (?:creati |a cura )?(?:da|di)", "sottotitoli e (?:a presto|revisione)", "grazie per la visione",
)

# Wordings of a read for a sponsor of which one is enough.
STRONG_CUES = (
    "promo code", "use (?:the )?(?:promo |offer |discount )?code", "coupon code", "offer code", "discount code", r"code [\p{L}\d]+ at checkout", "brought to you by",
    "this (?:episode|show|podcast|segment) is (?:sponsored|supported|brought to you|presented|made possible)",
    "support for (?:this|the|today['’]s) (?:show|podcast|episode) comes from",
    "(?:a )?word from our sponsors?", "thanks to our sponsors?", "today['’]s sponsors?",
    "(?:today['’]s|this (?:episode|week)['’]s|our|the show['’]s) (?:presenting|title|lead|main) sponsors?",
    r"partnered with [\p{L}\d&.'’ -]{1,40}? to (?:offer|bring|give) (?:our|my) listeners",
    r"(?:type|enter|use|mention|put) (?:in )?[\p{L}\d .'’-]{1,40}? at checkout",
    "lets? them know (?:that )?(?:we|i) sent you", "terms (?:and conditions )?apply", "restrictions apply", "see site for details",
    "code promo", "code de réduction", "sponsorisé par", "cet épisode est (?:sponsorisé|présenté|soutenu)",
    "rabattcode", "gutscheincode", "gesponsert von", "diese (?:folge|episode) wird (?:präsentiert|unterstützt|gesponsert)", "unbezahlte werbung",
    "código (?:de descuento|promocional)", "patrocinado por", "este (?:episodio|programa) (?:está patrocinado|es posible gracias)",
    "codice sconto", "sponsorizzato da", "questo episodio è (?:sponsorizzato|offerto)",
    "rabattkode", "rabatkode", "sponset av", "sponsoreret af",
)

# Weaker wordings, of which two are needed.
WEAK_CUES = (
    r"(?i)\b(?:visit|go to|head (?:over )?to|check out) [\w-]+(?:\.[\w-]+)*\.(?:com|co|org|net|io|ai)\b",
    r"(?i)\b[\w-]+\.(?:com|co|net|io)/[\w-]+|\bdot (?:com|co|net|io) slash \w+|\b[\w-]+\.(?:com|co|net|io|org) slash [\w-]+",
    r"(?iu)\b(?:visit|go to|head (?:over )?to|check out) (?:[\p{L}\d'’-]+ ){1,5}dot (?:com|co|org|net|io)\b",
    r"(?i)\$\d+(?:\.\d{2})? (?:a|per) (?:month|year)\b|\bplans? start(?:ing)? at\b",
    r"(?i)\bfree trial\b",
    r"(?i)\b\d+ ?(?:%|percent) off\b",
    r"(?i)\bfirst (?:month|order|box)\b",
    r"(?i)\bsign up (?:today|now)\b",
    r"(?i)\b(?:download|get) the [\w ]{2,20} app\b",
    r"(?i)\blimited time\b",
    r"(?i)\bfree shipping\b",
    r"(?i)\bmoney[- ]back guarantee\b",
    r"(?i)\b(?:special|exclusive) offer\b",
)

# Fixed values: "sponsored by" counts unless the sentence is about a law or a state; wordings that open a read.
SPONSORED = r"(?iu)(?<![\p{L}-])sponsored by(?![\p{L}])"
NOT_A_SPONSOR = r"(?i)\b(bills?|legislation|amendments?|resolutions?|senators?|senate|congress\w*|representatives?|lawmakers?|co-?sponsor\w*|state[- ]sponsored|government[- ]sponsored|terroris[mt])\b"
OPENERS = ("brought to you by", "sponsored by", "support for (?:this|the|today['’]s) (?:show|podcast|episode) comes from", "is (?:supported|presented|made possible) by", "word from our sponsors?", "today['’]s sponsors?")

# A person's name, and words that begin a show's title without being one.
PERSON = r"\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}[\p{L}'’.-]+){1,2}"
NOT_A_NAME = "The|This|Daily|Weekly|Morning|Evening|Big|Real|Last"
SHOW_KINDS = "Show|Podcast|Experience|Hour|Program|Interview|Pod"

# Endings that make a plural or a genitive rather than another name.
ENDINGS = "s|es|e|en|n|er|ern|ens|nen"

# Words that begin sentences and ride along with names.
STARTERS = "later today then so and but well yes no now also here when after before first next sure right okay oh yeah and or because if while since again still just thanks".split()

# Everyday words; a match of another number of words than the term's is not made of these alone.
COMMON = """the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or an will my one all would there their
what so up out if about who get which go me when make can like time no just him know take people into year your good some could them see other than then now look
only come its over think also back after use two how our work first well way even new want because any these give day most us is was are were been has had did said
open air new face phase cloud code in video wong way high hand low light right left big small long short old young great little own same few more much many such part
place case point world life hand week company number group problem fact""".split()

# The languages that are transcribed, by the tags that feeds use for them.
LANGUAGES = {"en": "english", "nb": "norwegian", "no": "norwegian", "nn": "norwegian", "da": "danish", "fr": "french", "de": "german", "es": "spanish", "it": "italian"}

# Fixed value: a line of notes that begins with a time.
CHAPTER_LINE = r"^(?:[-*•·]\s*)?[\[(]?(\d{1,2}:\d{2}(?::\d{2})?)[\])]?(?:\s*[-–—:|.]+\s*|\s+)(\S.*)$"

# The parts of a query, and what parts its words.
QUERY_PART, NO_WORD = r'"([^"]*)"?|([^\s"]+)', r"[^\p{L}\p{N}]+"

# A name that a read may sell under, capitalised words that are none, and words that bring the show back.
SOLD_NAME = r"(?<![\p{L}\d])\p{Lu}[\p{L}\d'’-]{2,}"
NOT_SOLD = """The And But So Now This That With When What Our Your You We It If Right Okay Alright Here There They She He Just Today Visit Get Try For Plus
Terms Go Head""".split()
RESUMES = (
    r"(?i)\b(?:welcome(?: back)? to|(?:my|our) (?:conversation|interview|chat|talk) with|joining (?:me|us)|back to the show|(?:and )?we(?:'re| are) back|"
    r"let['’]?s get (?:back )?(?:into|to) it|on the show today|today on the show)\b"
)

# Wordings with which a voice names itself, names its guest, and welcomes, and openings of a question.
INTRODUCES = (
    "I'm", "I am", "my name is", "my name's", "jeg er", "jeg heter", "jeg hedder", "mitt navn er", "mit navn er", "je suis", "je m'appelle", "moi c'est",
    "ich bin", "ich heiße", "mein name ist", "soy", "me llamo", "mi nombre es", "sono", "mi chiamo", "il mio nome è",
)
HOSTS = (
    "I'm here with", "I am here with", "I'm joined (?:today |now )?by", "joining me (?:today |now |this week )?(?:is|are)", "my guest (?:today |this week )?is",
    "today I'm (?:talking|speaking) (?:with|to)", "I'm (?:talking|speaking) (?:today )?(?:with|to)",
)
WELCOMES = (
    "welcome", "velkommen", "bienvenue", "bienvenu", "bienvenus", "willkommen", "herzlich willkommen", "bienvenido", "bienvenida", "bienvenidos",
    "benvenuto", "benvenuta", "benvenuti",
)
WELCOME_BACK = "back|tilbake|igen|de nouveau|zurück|de nuevo|di nuovo"
WELCOME_PLACE = (
    "to the (?:show|program|podcast)", "(?:dans|à) (?:l'émission|le podcast)", "(?:in der sendung|im podcast|bei uns)", "(?:al (?:programa|podcast))",
    "(?:nel podcast|in trasmissione)",
)
ADDRESS_OPENERS = "So|And|Well|OK|Okay|Alors|Et|Also|Und|Bueno|Y|Allora|E|Så|Og"

# Last words that make a capitalised pair an organisation or a thing.
NOT_PERSONS = """foundation times post news institute university college school company corporation corp inc group lab labs show podcast network media studio
studios production productions records press journal review magazine council committee agency department ministry party bank fund association society club
center centre recommendation recommendations risk risks house street park city state states ai tv radio kingdom union republic nations church museum
hospital court office program project""".split()

# kbit/s of MPEG audio by version (1, or 2 and 2.5), layer and index, and sampling rates by the header's version bits.
MPEG_KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

# Words that every title has, and what stands before an episode's number.
TITLE_FILLER = "podcast podcasts episode episodes ep full the a an and of with feat ft audio video official interview show part with mit avec con et und y e le la el il der die das".split()
EPISODE_WORDS = "ep|eps|episode|episodio|épisode|folge|puntata|afsnit|avsnitt|episod"

# Lines that look like a speaker's label and are none.
NO_LABELS = r"NOTE|TRANSCRIPT|EPISODE|SHOW NOTES|PREVIOUS|NEXT|SHARE|COPYRIGHT|SPONSOR|ADVERTISEMENT|SOURCES?|RESOURCES|PHOTO|IMAGE|TAGS|LISTEN|SUBSCRIBE|SEE ALSO|READ MORE|RELATED"
