"""English sentence boundaries: labelled cases, | marks where a sentence ends."""

import pytest
from pyspark.sql import functions as F

from turnlake.functions.sentences import english_sentences
from turnlake.operators import chunking

CASES = [
    "Hello there.| My name is Ada.",
    "What is your name?| My name is Ada.",
    "There it is!| I found it.",
    "My name is Ada E. Lovelace.",
    "Dr. Smith met Mr. Jones at 5 p.m. today.",
    "Please turn to p. 55.",
    "Were Ada and co. at the party?",
    "They closed the deal with Pitt, Briggs & Co. at noon.",
    "Let's ask Ada and Co.| They should know.",
    "They closed the deal with Pitt, Briggs & Co.| It closed yesterday.",
    "I can see Mt. Fuji from here.",
    "St. Michael's Church is on 5th St. near the light.",
    "That is Jane F. Kennedy Jr. speaking.",
    "I live in the E.U.| How about you?",
    "I live in the U.S.| How about you?",
    "I work for the U.S. Government in Virginia.",
    "I have lived in the U.S. for 20 years.",
    "At 5 a.m. Mr. Smith went to the bank.| He left the bank at 6 P.M.| Mr. Smith then went to the store.",
    "She has $100.00 in her bag.",
    "She has $100.| It is in her bag.",
    "Pi is about 3.14159 or so.| Tau is twice that.",
    "He teaches science (he worked for 5 years as an engineer. He likes it.) at the local school.",
    "Her email is ada.lovelace@example.com.| I sent her one.",
    "The site is: https://www.example.50.com/new-site/awesome.html.| Please check it out.",
    'She turned to him, "This is great." she said.',
    'She turned to him, "This is great."| She held the book out to show him.',
    "She said, “Come in. Sit down.” and smiled.",
    "Hello!!| Long time no see.",
    "Hello??| Who is there?",
    "Hello!?| Is that you?",
    "Hello?!| Is that you?",
    "1. The first item\n|2. The second item",
    "a. The first item\n|b. The second item",
    "iv. The fourth item\n|v. The fifth item",
    "1.) The first item\n|2.) The second item",
    "This is a sentence\n|cut off in the middle because of a line break.",
    "You can find it at N°. 1026.253.553.| That is where the treasure is.",
    "She works at Yahoo! in the accounting department.",
    "We make a good team, you and I.| Did you see Albert I. Jones yesterday?",
    "Thoreau argues that by simplifying one’s life, “the laws of the universe will appear less complex. . . .”",
    "It rained ... all day long.",
    "I never meant that....| She left the store.",
    "I wasn’t really ... well, what I mean ... see . . . what I am saying is this.",
    "One further habit was weakened . . . and then it went.",
    "The result, i.e. the sum, is fine.| We are done.",
    "Use fruit, e.g. apples or pears.| Wash them first.",
    "Bring pens, paper, etc.| We start at nine.",
    "Bring pens, paper, etc. to the room.",
    "See Fig. 3 and eq. 4 for details.| No. 5 is missing.",
    "It was Smith et al. who found it.",
    "It happened on Jan. 5 in the morning.| Nobody saw it.",
    "Acme Inc. was sold.| Then Widget Ltd. bought it.",
    "He has a Ph.D. in physics.| She has an M.A. in art.",
    "J. R. R. Tolkien wrote it.| C. S. Lewis read it.",
    "Prof. Dr. Meyer spoke first.| Gen. Lee followed.",
    "Is it 3 vs. 4 or 4 vs. 5?| Nobody knows.",
    "Version 2.0.1 is out!| Get it now.",
    "Wait… what?| Really.",
    "Wait…| What is that?",
    "(This is a whole sentence.)| This is another one.",
    "He asked “Why?” and left.| She stayed.",
    "The price rose approx. 5 percent.| It fell later.",
    "Call me at 9 a.m. tomorrow.| Or at 10 p.m.| I am up late.",
    "The Rev. Green met Sen. Brown and Gov. White.",
    "The store on Fifth Ave. is open.| The other one is not.",
    "Two spaces.  |Then a tab.\t|Then the end.",
    "no capital. |still a sentence.",
    "What?! |no. |yes!",
    "A question in a bracket (is it?) is no end.",
    "[Note. This is a note.]| The text goes on.",
    "Ms. Mx. and Mme. Curie are titles.",
    "J.F.K. was president.| He was young.",
    "The U.K. and the U.S.A. agreed.| France did not.",
    "   Leading and trailing blanks.   |\n\n|   A new paragraph.  ",
    "No end sign",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame(list(enumerate(c.replace("|", "") for c in CASES)), "n int, text string")
    return {r["n"]: r["s"] for r in rows.select("n", english_sentences(F.col("text")).alias("s")).collect()}


def test_labelled_cases(found):
    assert len(CASES) >= 60
    want = {n: [p.strip() for p in c.split("|") if p.strip()] for n, c in enumerate(CASES)}
    assert {n: (want[n], found[n]) for n in want if want[n] != found[n]} == {}


def test_sentences_are_parts_of_their_text(spark, found):
    for n, case in enumerate(CASES):
        text, at = case.replace("|", ""), 0
        for part in found[n]:
            at = text.index(part, at) + len(part)


def test_nothing_and_much(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (4, "Mr. X is here. " * 20_000), (5, '"' + "He said so. " * 20_000)], "n int, text string")
    found = {r["n"]: r["s"] for r in rows.select("n", english_sentences(F.col("text")).alias("s")).collect()}
    assert not found[1] and found[2] == found[3] == []
    assert found[4] == ["Mr. X is here."] * 20_000 and len(found[5]) == 20_000


def test_chunks_of_english_sentences(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Dr. Smith met Mr. Jones at 5 p.m. today. He was late.")], "conv_id long, turn long, role string, text string")
    chunks = chunking.chunk(rows, chunking.ChunkerConfig(1, 15), splitter=english_sentences).orderBy("pos").collect()
    assert [(c["text"], c["start_char"], c["end_char"]) for c in chunks] == [("Dr. Smith met Mr. Jones at 5 p.m. today.", 0, 40), ("He was late.", 41, 53)]
