"""Word and phrase lists of the rules."""

from __future__ import annotations

# Results depend on exactly these words and phrases.

WEASELS = (
    """
    absolutely certainly clearly considerably countless definitely dramatically drastically
    enormously exceedingly extremely few hugely immensely importantly incredibly interestingly
    literally many most notably numerous obviously relatively remarkably several significantly some
    substantially surely surprisingly tremendously undoubtedly utterly vast vastly various wildly
    """
).split()

HEDGES = (
    """
    actually allegedly almost apparently approximately arguably basically conceivably essentially
    fairly generally hopefully just largely likely mainly marginally maybe moderately mostly nearly
    occasionally often ostensibly partially partly perhaps possibly potentially presumably probably
    purportedly quite rather really reportedly reputedly roughly seemingly slightly somehow somewhat
    sometimes supposedly theoretically typically unlikely usually very virtually
    """
).split()

HEDGE_PHRASES = (
    "a bit",
    "a little bit",
    "as far as i can tell",
    "by and large",
    "for the most part",
    "give or take",
    "i believe",
    "i feel like",
    "i guess",
    "i suppose",
    "i think",
    "if you ask me",
    "in a sense",
    "in my opinion",
    "in my view",
    "in some ways",
    "it appears",
    "it could be argued",
    "it might be said",
    "it seems",
    "kind of",
    "more or less",
    "or something like that",
    "sort of",
    "to a certain extent",
    "to some extent",
    "up to a point",
)

CLICHES = (
    "a double-edged sword",
    "a win-win",
    "all things considered",
    "at the drop of a hat",
    "at the end of the day",
    "at this point in time",
    "back to the drawing board",
    "beat around the bush",
    "boil the ocean",
    "circle back",
    "cut to the chase",
    "each and every",
    "easier said than done",
    "few and far between",
    "first and foremost",
    "food for thought",
    "going forward",
    "grasping at straws",
    "hit the ground running",
    "in a nutshell",
    "in this day and age",
    "last but not least",
    "leave no stone unturned",
    "level playing field",
    "low-hanging fruit",
    "move the needle",
    "needless to say",
    "off the beaten path",
    "only time will tell",
    "par for the course",
    "push the envelope",
    "raise the bar",
    "take it to the next level",
    "the best of both worlds",
    "the bottom line",
    "the calm before the storm",
    "the elephant in the room",
    "the fact of the matter",
    "the tip of the iceberg",
    "the writing on the wall",
    "think outside the box",
    "touch base",
    "when all is said and done",
    "when push comes to shove",
)

NOT_ADVERBS = (
    """
    ally anomaly apply assembly belly brotherly bubbly bully burly butterfly chilly comely comply
    costly cowardly crumbly curly daily deadly dolly dragonfly early elderly family fatherly firefly
    fly folly friendly ghastly ghostly gully hilly holly holy homely homily imply italy jelly jolly
    july leisurely likely lily lively lonely lovely manly melancholy molly monopoly monthly motherly
    multiply neighborly neighbourly nightly oily only orderly panoply ply portly prickly quarterly
    rally rely reply saintly scholarly sicily sickly silly sly stately sully supply surly tally
    timely ugly unlikely unruly unsightly weekly wily wobbly womanly woolly worldly wrinkly yearly
    """
).split()

IRREGULAR_PARTICIPLES = (
    """
    arisen awoken beaten become been begun beheld bent bet bitten blown born borne bought broken
    brought built burnt burst cast caught chosen clung come cost crept cut dealt done drawn dreamt
    driven drunk dug dwelt eaten fallen felt fit flown flung forgiven forgotten forsaken fought
    found frozen given gone grown heard held hidden hit hung hurt kept knelt known laid led left
    lent let lost made meant met misled mistaken mown overcome overdone overseen overtaken paid
    proven put quit read redone ridden risen run said sat sawn seen sent set sewn shaken shot shown
    shrunk shut slain slept sold sought sown spent spilt split spoilt spoken spread sprung spun
    stolen struck stuck stung strewn strung sung sunk swept swollen sworn swung taken taught thought
    thrown thrust told torn understood undertaken undone upheld withdrawn withheld woken won worn
    wept wrought written
    """
).split()

NOT_PARTICIPLES = (
    """
    aged bed biped bled bloodshed bobsled bred breed creed crooked deed dogged embed exceed feed
    flatbed fled godspeed greed hatred heed hundred indeed jagged misdeed moped naked need proceed
    quadruped ragged red reed rugged sacred seaweed seed shed shred sled sped speed steed succeed
    tweed watershed wed weed wicked wretched
    """
).split()

MACHINE_WORDS = (
    """
    beacon bustling comprehensive cornerstone crucial cultivate delve delves delving elevate
    elevates elevating embark embarking embarks empower empowering empowers ever-changing
    ever-evolving foster fostering fosters groundbreaking hallmark harness harnessing holistic
    illuminate indelible intricate intricacies invaluable landscape leverage leverages leveraging
    meticulous meticulously multifaceted myriad nuanced paramount pivotal plethora profound realm
    resonate robust seamless seamlessly showcase showcased showcases showcasing streamline
    streamlined synergy tapestry testament transformative underpin underpins underscore underscored
    underscores underscoring unlock unlocking unlocks unparalleled unwavering utilize utilizing
    vibrant vital
    """
).split()

MACHINE_PHRASES = (
    "a game-changer",
    "a myriad of",
    "a testament to",
    "a wide range of",
    "additionally",
    "as we've seen",
    "at the forefront of",
    "buckle up",
    "cutting-edge",
    "delve into",
    "dive deep",
    "embark on a journey",
    "ever-evolving landscape",
    "furthermore",
    "harness the power",
    "holistic approach",
    "in conclusion",
    "in summary",
    "in the ever-evolving",
    "in the realm of",
    "in today's fast-paced world",
    "it is important to note",
    "it is worth noting",
    "it's important to note",
    "it's worth noting",
    "key takeaways",
    "let's dive in",
    "look no further",
    "meticulously crafted",
    "moreover",
    "navigate the complexities",
    "paradigm shift",
    "plays a crucial role",
    "plays a vital role",
    "push the boundaries",
    "rich tapestry",
    "seamless integration",
    "shed light on",
    "stand the test of time",
    "that being said",
    "the possibilities are endless",
    "to summarize",
    "underscores the importance",
    "unlock the potential",
    "unwavering commitment",
    "when it comes to",
)

STOPWORDS = (
    """
    a about after again against all also am an and any are as at back be because been before being
    both but by can could did do does doing done down each even for from get gets go goes going got
    had has have he her here hers him his how i if in into is it its just let like make makes made
    may me might more most much must my no not now of off on once one only or other our ours out
    over own put same say says she should since so some still such take than that the their theirs
    them then there these they this those through to too two under until up us very was we well were
    what when where which while who whom why will with would you your yours
    """
).split()

BE_FORMS = "am is are was were be been being isn't aren't wasn't weren't".split()
GET_FORMS = "get gets got gotten".split()
MODALS = "should shall can could may might must will would cannot ought".split()
BETWEEN = (
    "not never always often sometimes seldom still already just also even only now then soon again once ever well all both no longer being"
).split()
ED_ADJECTIVES = (
    """
    tired excited worried confused interested pleased surprised delighted concerned bored scared frightened annoyed embarrassed
    exhausted ashamed disappointed frustrated satisfied aged crowded talented gifted skilled tanned
    """
).split()
NOT_AGENTS = "then now default mistake accident chance design comparison contrast far itself necessity".split()
