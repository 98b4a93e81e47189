"""Word lists of the analyzer, in normalized form (lower case, folded)."""

# Results depend on exactly these words, affixes and letters.

STOP_LATIN = frozenset("""
a about above after again against all also am an and any are as at be because been before being below between both but by
can could did do does doing dont down during each few for from further had has have having he her here hers him his how i
if in into is it its just me more most my no nor not of off on once only or other our ours out over own same she
should so some such than that the their theirs them then there these they this those through to too under until up very was
we were what when where which while who whom why will with would you your yours
le la les des du et un une est dans pour que qui sur pas au aux ce cette il elle nous vous ils avec par
el los las del y es una por con para se lo al su sus
der das den dem des und ist ein eine einer nicht mit von zu auf im sich
di che gli della os da dos em um uma nao
""".split())

STOP_ARABIC = frozenset("""
و در به از که این را با است برای آن یک خود تا بر هم نیز شد ما اما یا شده باید هر آنها بود او دیگر وی
کنند کند دارد شود همه نه ولی پس اگر بین چه روی همین چون شوند بودن کرد کرده کردن میشود میکند ای اینکه آنکه هیچ
شما ایشان من تو آنان اینها
فی علی الی عن ان هذا هذه التی الذی لا کان مع هو هی
""".split())

STOP_CYRILLIC = frozenset("""
и в во не на я что он с со как а то все она так его но да ты к у же вы за бы по только ее мне было
вот от меня еще нет о из ему это для при или был были
""".split())

#: Detached affixes that are joined to their words.
PREFIXES = frozenset(("می", "نمی"))
SUFFIXES = frozenset(("ها", "های", "هایی", "هایم", "هایت", "هایش", "هایمان", "هایتان", "هایشان", "ترین"))

#: Endings that the stemmer cuts after a joiner, and endings that it cuts without one.
JOINED_ENDINGS = ("هایشان", "هایتان", "هایمان", "هایی", "هایم", "هایت", "هایش", "های", "ها", "ترین", "تر", "ای", "ی")
ATTACHED_ENDINGS = ("هایشان", "هایتان", "هایمان", "هایی", "های", "ها", "ترین")

#: Letters that are easily taken for one another, in groups.
CONFUSABLE = ("کگ", "بپ", "جچ", "زژ", "رز", "زذضظ", "دذ", "حخ", "حه", "سصث", "تط", "قغ", "اآع", "یئ")

ALTERNATIVES: dict[str, frozenset[str]] = {c: frozenset("".join(g for g in CONFUSABLE if c in g)) - {c} for c in "".join(CONFUSABLE)}
