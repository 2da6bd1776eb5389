"""Word lists, thresholds and tables whose contents decide results. Stated as they must be, in their usual order."""

from __future__ import annotations

import regex

DELETED = ("[deleted]", "[removed]", "[deleted by user]", "", ".")

# fixed values: function words of five languages; the first language with most hits wins
LANGUAGE_MARKERS = {
    "de": ("ich", "und", "nicht", "das", "ist", "mit", "auch", "aber", "wenn", "auf"),
    "es": ("que", "para", "como", "pero", "esta", "este", "muy", "todo", "con", "por"),
    "fr": ("les", "des", "une", "est", "pas", "pour", "dans", "qui", "avec", "sur"),
    "pt": ("nao", "para", "com", "uma", "que", "mais", "seu", "por", "como"),
    "it": ("che", "non", "per", "sono", "questo", "come", "anche", "della"),
}

# fixed values: romanised Hindi function words
HINGLISH_MARKERS = tuple(
    """hai nahi kya yaar bhai matlab acha accha bohot bahut kar raha rahi hoon mera tera apna abhi kuch phir lekin agar toh bhi koi jab tab
    mein karo kaise kyun thoda sab log baat ho hain""".split()
)

# fixed values: markup and platform artefacts that aren't vocabulary
MARKUP_NOISE = tuple(
    """https http www redd png jpg jpeg webp gif svg amp nbsp quot gt lt utm src href width height preview format auto blur crop thumbnail
    imgur gyazo pbs twimg cdn media redgifs giphy youtu youtube reddit wikipedia wiki php html json api url uri""".split()
)

# fixed values: chat emotes, which count as emoji
EMOTES = tuple(
    dict.fromkeys(
        """kekw omegalul lul lulw pogchamp pog poggers sadge monkas pepega pepehands widepeepohappy catjam ez gg copium hopium malding kappa
    pepelaugh 5head peepohappy aware clueless icant modcheck nodders based ratio madge feelsgoodman feelsbadman sodaomega kekl pepeds susge
    peepod widepeepo hypers pauseçhamp pausechamp monkaw monkahmm sadcat plink ratjam vibe gigachad chad cringe sheesh yep nopers okayeg docl
    lidl actually scam weirdchamp pogu poggies 3head kok chatting bedge sleeper tuck""".split()
    )
)

# fixed values: chat abbreviations
ABBREVIATIONS = tuple(
    dict.fromkeys(
        """ngl tbh istg ong fr iykyk nvm wdym hbu smh lmao lmfao lol rofl imo imho idk idc ikr tysm ty np nt gg brb afk irl tbf ftw rn atm
    btw fyi asap omg wtf wth af ffs istfg nvmd pmo sybau icl lowkey highkey deadass fs ts gyat wsp wyd hyd ily ilysm gn gm sm rlly prolly bc
    cuz tho thru u ur yr pls plz thx k ppl ig dm rt tldr tl;dr xd bf gf bff dw ez ofc nsfw til eli5 iirc afaik op mf txt faq pm dl ul src img
    msg rq""".split()
    )
)

# fixed values: function words of edited prose
FORMAL_MARKERS = tuple(
    """however therefore moreover furthermore nevertheless consequently additionally accordingly whereas thus regarding concerning
    approximately significant particular""".split()
)

# fixed values: bucket edges of the register dimensions, in their order
REGISTER_EDGES = {
    "slang": (0.5, 2.0, 5.0, 10.0),
    "emoji": (0.5, 2.0, 6.0),
    "abbrev": (2.0, 6.0, 14.0),
    "elong": (1.0, 4.0),
    "formal": (0.30, 0.55, 0.78),
}
MIN_RATE_TOKENS = 30
AMBIGUOUS_WEIGHT = 0.3

# fixed values: default curriculum
CURRICULUM = (
    ("S1", 0.667, {"general": 1.0}),
    ("S2", 0.967, {"general": 0.40, "internet": 0.35, "genz": 0.20, "lexicon": 0.02, "hinglish": 0.03}),
    ("S3", 1.000, {"general": 0.20, "internet": 0.25, "genz": 0.50, "lexicon": 0.02, "hinglish": 0.03}),
)

HALF_LIFE_YEARS = 3


def emoji_class() -> str:
    """Extended_Pictographic as ranges, which Java's regular expressions and RE2 both read; made from the Unicode table of ``regex``."""
    pattern, ranges = regex.compile(r"\p{Extended_Pictographic}"), []
    for cp in range(0xA9, 0x1FFFF):
        if not 0xD800 <= cp <= 0xDFFF and pattern.match(chr(cp)):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges) + "]"


EMOJI = emoji_class()
# the same, beyond what is prose: Java looks at the ranges of EMOJI one after another
EMOJI_JAVA = r"[\x{A9}\x{AE}\x{203C}-\x{1FFFF}&&" + EMOJI + "]"
