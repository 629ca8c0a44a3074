"""Rule-based English lemmas of nouns and verbs: exceptions first, then endings."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms that no ending rule gives.
_GROUPS = """
be:am,is,are,was,were,been,being have:has,had,having do:does,did,done,doing go:goes,went,gone,going
say:said make:made take:took,taken come:came see:saw,seen get:got,gotten,getting know:knew,known give:gave,given find:found
think:thought tell:told become:became show:shown leave:left feel:felt put:putting bring:brought begin:began,begun,beginning
keep:kept hold:held write:wrote,written stand:stood hear:heard let:letting mean:meant set:setting meet:met run:ran,running
pay:paid sit:sat,sitting speak:spoke,spoken lie:lay,lain,lying lead:led read:reading grow:grew,grown lose:lost fall:fell,fallen
send:sent build:built understand:understood draw:drew,drawn break:broke,broken spend:spent cut:cutting rise:rose,risen
drive:drove,driven buy:bought wear:wore,worn choose:chose,chosen seek:sought throw:threw,thrown catch:caught deal:dealt
win:won,winning forget:forgot,forgotten eat:ate,eaten drink:drank,drunk sing:sang,sung swim:swam,swum fly:flew,flown,flies
sleep:slept sell:sold teach:taught fight:fought steal:stole,stolen hide:hid,hidden strike:struck shake:shook,shaken die:dying,died,dies
tie:tying,tied,ties ride:rode,ridden bite:bit,bitten beat:beaten bind:bound lend:lent bend:bent dig:dug,digging hang:hung
man:men woman:women child:children foot:feet tooth:teeth goose:geese mouse:mice louse:lice ox:oxen person:people
life:lives wife:wives knife:knives half:halves wolf:wolves leaf:leaves shelf:shelves thief:thieves self:selves calf:calves
loaf:loaves elf:elves dwarf:dwarves crisis:crises analysis:analyses basis:bases thesis:theses oasis:oases axis:axes
phenomenon:phenomena criterion:criteria datum:data medium:media bacterium:bacteria stratum:strata index:indices matrix:matrices
cactus:cacti fungus:fungi nucleus:nuclei radius:radii alumnus:alumni hero:heroes potato:potatoes tomato:tomatoes echo:echoes
movie:movies cookie:cookies pie:pies shoe:shoes toe:toes good:better,best bad:worse,worst
"""
EXCEPTIONS = {form: base for group in _GROUPS.split() for base, forms in [group.split(":")] for form in forms.split(",")}

#: Words that end like an inflection and aren't one.
_WHOLE = frozenset(
    "news series species means physics mathematics politics economics gas bus lens plus thus this his its us yes less unless across always perhaps "
    "thing king ring wing spring string morning evening during nothing something anything everything ceiling wedding building "
    "bed red need seed feed speed breed hundred indeed weed sacred wicked naked kindred shed sled fed led bred".split()
)
_VOWELS = "aeiouy"


def _undoubled(stem: str) -> str:
    """What was before -ed or -ing: a doubled consonant is single, and some stems had an e."""
    if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "aeiouylsz":
        return stem[:-1]
    if stem.endswith(("at", "iz", "bl", "v", "dg", "nc", "rg", "u", "is", "us", "as", "c")) and not stem.endswith(("treat", "heat", "beat", "cheat", "repeat", "oat")):
        return stem + "e"
    short = len(stem) >= 2 and stem[-1] not in _VOWELS + "wx" and stem[-2] in _VOWELS and sum(c in _VOWELS for c in stem) == 1
    return stem + "e" if short and len(stem) == 3 else stem


@lru_cache(maxsize=65536)
def lemma(word: str) -> str:
    """The base form of one word in lower case; a word that no rule fits is its own."""
    w = word.lower()
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    if len(w) <= 3 or w in _WHOLE or not w.isalpha():
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith(("sses", "shes", "ches", "xes", "zzes")):
        return w[:-2]
    if w.endswith("s") and not w.endswith(("ss", "us", "is")):
        return w[:-1]
    if w.endswith("ied"):
        return w[:-3] + "y"
    for ending in ("ed", "ing"):
        stem = w[: -len(ending)]
        if w.endswith(ending) and len(stem) > 2 and any(c in _VOWELS for c in stem):
            return _undoubled(stem)
    return w


def lemmas(label: str) -> str:
    """The lemmas of the words of a label, parted by single spaces."""
    return " ".join(lemma(w) for w in label.split())


def lemma_column(label: Column) -> Column:
    """``lemmas`` of a column, by the Arrow batch; only distinct labels should come here."""

    @F.pandas_udf("string")
    def run(labels: pd.Series) -> pd.Series:
        return labels.map(lemmas, na_action="ignore")

    return run(label)
