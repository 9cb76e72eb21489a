"""English sentence boundaries as column expressions: signs that end no sentence are hidden, the text is cut behind the others, and the hidden ones come back.

Every stage is one regular expression without look-around, so that other engines
can run the same ones. Hidden signs stand as characters that Unicode keeps for such
use and that no text holds (U+FDD0 to U+FDD6).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.functions.text import let, strip

#: A full stop, question and exclamation mark that end no sentence; a full stop that ends one only before a word that often starts one; three dots in one that end none; a full stop behind the marker of a list; the ends of a span.
STOP, ASKS, CRIES, WEAK, DOTS, ITEM, SPAN = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4", "\ufdd5", "\ufdd6"

# Words that a full stop belongs to.
#: Before a name, never at the end of a sentence.
TITLES = "Mr|Mrs|Ms|Mx|Dr|Prof|Rev|Hon|Gen|Col|Capt|Cpt|Maj|Lt|Cmdr|Adm|Sgt|Cpl|Sen|Rep|Gov|Pres|Supt|Insp|Msgr|Messrs|Mme|Mlle|Fr|St|Mt|Ft"
#: Inside a sentence, whatever follows.
LINKS = "e\\.g|i\\.e|eg|ie|vs|cf|viz|ca|resp|approx|esp|incl"
#: Before a number.
BEFORE_NUMBERS = "N°|No|Nos|no|nos|p|pp|vol|Vol|fig|Fig|figs|Figs|sec|Sec|ch|Ch|art|Art|eq|Eq|ex|Ex|par|Par|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
#: Inside a sentence or at its end: what follows tells.
EITHER = "etc|al|Inc|Ltd|Co|co|Corp|Bros|LLC|Jr|Sr|Esq|Dept|dept|Univ|univ|Assn|assn|est|Ave|Blvd|Rd|ft|lb|lbs|oz|min|max|hr|hrs|sec|tel|Tel|ext|Ext|Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|a\\.m|p\\.m"
#: Words that often start a sentence and seldom follow an abbreviation inside one.
STARTERS = (
    "A|An|The|This|That|These|Those|There|Then|Here|It|Its|He|His|She|Her|We|Our|You|Your|They|Their|I|My|In|On|At|By|For|From|With|After|Before|When|Where|While|Why|What|Which|Who|How|If|As|But|And|Or|So|Yet|Also"
    "|However|Now|Today|Yesterday|Tomorrow|Later|Did|Do|Does|Is|Are|Was|Were|Will|Would|Can|Could|Should|May|Please|Let|No|Not|Yes|Many|Some|Most|All|Each|Once|Since|Although|Because"
)

#: What stands before a word; written out, as engines differ in what they take for the edge of a word.
EDGE = r"(^|[^\p{L}\p{N}])"
#: What is hidden: (pattern, what stands for it), in this order.
HIDE = (
    # markers of lists at the start of a line: 1. 12) a. iv.
    (r"(^|\n)([ \t]*(?:[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,4}))\.(\)?[ \t])", rf"$1$2{ITEM}$3"),
    # dots between blanks, three dots within a sentence
    (r"\.[ ]\.[ ]\.", f"{STOP} {STOP} {STOP}"),
    (r"\.\.\.(\s+[a-z])", rf"{STOP * 3}$1"),
    (r"…(\s+[a-z])", rf"{DOTS}$1"),
    # words that a full stop belongs to
    (rf"{EDGE}({TITLES})\.", rf"$1$2{STOP}"),
    (rf"{EDGE}({LINKS})\.", rf"$1$2{STOP}"),
    (rf"{EDGE}({BEFORE_NUMBERS})\.(\s*[0-9])", rf"$1$2{STOP}$3"),
    (rf"{EDGE}({EITHER})\.(\s+[a-z0-9(\[$€£&])", rf"$1$2{STOP}$3"),
    (rf"{EDGE}({EITHER})\.(\s+[A-Z])", rf"$1$2{WEAK}$3"),
    # acronyms with dots: U.S. and Ph.D., the time of day in capitals
    (rf"{EDGE}((?:[A-Za-z]{{1,2}}\.)+[A-Za-z]{{1,2}})\.(\s+[a-z0-9(\[$€£&,;])", rf"$1$2{STOP}$3"),
    (rf"{EDGE}([AP]\.M)\.(\s+[A-Z])", "$1$2.\n$3"),
    (rf"{EDGE}((?:[A-Za-z]{{1,2}}\.)+[A-Za-z]{{1,2}})\.(\s+[A-Z])", rf"$1$2{WEAK}$3"),
    # initials; I is one only behind a name
    (rf"{EDGE}([A-HJ-Z])\.", rf"$1$2{WEAK}"),
    (r"([A-Z][a-z]+\s+I)\.(\s+[A-Z])", rf"$1{WEAK}$2"),
    # names that end with a mark
    (rf"{EDGE}(Yahoo|Jeopardy|Yum)!(\s)", rf"$1$2{CRIES}$3"),
    # what may be an end is one before a word that often starts a sentence
    (rf"{WEAK}(\s+(?:{STARTERS})(?:[^\p{{L}}\p{{N}}]|$))", r".$1"),
)
#: Text in quotes and brackets within a line: its signs end no sentence but for the last one, and that only before a capital.
SPANS = r"\"[^\"\n]+\"|“[^”\n]+”|\([^()\n]+\)|\[[^\[\]\n]+\]"
SHOW = tuple((hidden + r"([\"”)\]]+\s+[\"“(\[]?[A-Z])", sign + "$1") for hidden, sign in ((STOP, "."), (ASKS, "?"), (CRIES, "!"), (WEAK, ".")))
#: Where sentences end.
ENDS = (r"([.!?…]+[\"'”’)\]]*)\s+", "$1\n")


def _replaced(text: Column, stages) -> Column:
    for pattern, by in stages:
        text = F.regexp_replace(text, pattern, by)
    return text


def english_sentences(text: Column) -> Column:
    """The sentences of an English text, stripped, in order; none of a null or blank one. Each is a part of the text as it stands."""
    marked = F.split(F.regexp_replace(_replaced(text, HIDE), f"({SPANS})", f"{SPAN}$1{SPAN}"), SPAN)
    inside = let(marked, lambda parts: F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.translate(x, ".?!", STOP + ASKS + CRIES)).otherwise(x)), ""))
    cut = F.split(F.regexp_replace(_replaced(inside, SHOW), *ENDS), "\n")
    return F.filter(F.transform(cut, lambda x: strip(F.translate(x, STOP + ASKS + CRIES + WEAK + DOTS + ITEM, ".?!.…."))), lambda s: s != "")
