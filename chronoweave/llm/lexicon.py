"""Seed words for abusive, hateful and sexual language.

The lists are seeds, not the classifier: they give dense features (densities,
distances) whose weights are learned.  All words are stored as people write
them; ``abuse.normal`` brings words and text to the same form.
"""

# Coarse insults for people, several languages.
INSULTS = """
idiot idiots moron morons imbecile cretin dimwit halfwit nitwit dumbass dumb stupid asshole assholes bastard bastards
bitch bitches scumbag scum loser losers parasite pig swine clown jackass twat wanker prick dickhead douchebag
worthless useless pathetic gutless brainless spineless filthy disgusting miserable lazy ugly retard retarded
arschloch vollidiot versager fresse verpiss dummkopf hurensohn wichser missgeburt
connard connasse salope pauvre dégage crétin abruti enculé
gilipollas imbécil cabrón pendejo mierda inútil cállate pedazo hijo puta
coglione stronzo cretino deficiente bastardo cazzo
idiota imbecil burro otário kurwa debil suka idioot klootzak
""".split()

# Sexual words.
SEXUAL = """
sex porn porno nude nudes naked horny cock dick pussy tits boobs fuck fucked fucking fucks moan cum blowjob
strip lap bend beg slut whore cams singles erotic orgasm anal penis vagina
ficken geil nackt titten baise nue bite seins follar tetas desnuda polla scopare tette nuda
""".split()

# Words for degrading or threatening people.
HOSTILE = """
vermin animals disease rats breed ruin rot deserve beating thieves filth subhuman crawled driven belong
kill kills die dies hang bleach hammer choke chokes burn break fingers beat bleed punch shoot strangle stab
disappear ashamed raised birth hurt regret bury grave
basura ungeziefer raus larguen fremden extranjeros ratten abschaum parasiten vermine ordure
""".split()

# Words for the person spoken to.
SECOND = """
you your yours yourself u ur du dich dir dein deine sie ihr tu te toi ton vous eres tú ti tuo
""".split()

# Words for other people and groups spoken of.
PEOPLE = """
he she his her him they them their people women men girls guys guy boy sei foreigners immigrants faith
maintainer reviewer intern boss team mother family everyone nobody
""".split()
