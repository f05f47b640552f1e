"""Words of a text as the abuse classifier reads them, and phrases made up for its training.

Spellings that hide a word are undone as far as that can be told from the word alone: letter case, look-alike letters,
digits for letters, characters between letters, repeated letters and invisible characters. Words are of letters and digits
of any script. Latin letters lose their marks; scripts written without blanks are read sign by sign.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterable, Sequence

#: Letters of other scripts that look like a Latin one, and the one they look like.
LOOK_ALIKES = dict(zip("аеорсухіѕјһԁвкмнтіϲοανεїёӏ", "aeopcyxisjhdbkmhticoaveiel", strict=True))
#: Digits and signs written for letters.
LEET = dict(zip("0134578@$!", "oieastbasi", strict=True))
#: Latin letters that aren't a plain letter with a mark, and how they are read.
SPELT = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "Æ": "AE", "Œ": "OE", "Ø": "O", "Ł": "L", "Đ": "D"})
#: Signs that stand in a word for any letter.
MASKS = "*#@%?"

PAD, NUMBER, NAME = "<pad>", "<num>", "<name>"


def _ranges(codes: Iterable[int]) -> list[tuple[int, int]]:
    """The first and last of each run of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for c in codes:
        out = [*out[:-1], (out[-1][0], c)] if out and out[-1][1] == c - 1 else [*out, (c, c)]
    return out


_INVISIBLE = {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_LOOKS = str.maketrans(LOOK_ALIKES | {k.upper(): v.upper() for k, v in LOOK_ALIKES.items()})
#: Combining marks, which aren't of \w but belong to the letter before them, as ranges of a character class.
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(c for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M"))
#: Scripts written without blanks: Han, kana, Thai, Lao, Burmese, Khmer.
_UNSPACED = "\u0e01-\u0e30\u0e32\u0e40-\u0e46\u0e81-\u0eb0\u0ec0-\u0ec6\u1000-\u102a\u1780-\u17b3\u3005-\u3007\u3041-\u3096\u30a1-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._\-*·]){2,}[^\W\d_]{1,3}(?![^\W_])")
_SPACED_ONCE = re.compile(r"(?:\b[^\W\d_][ ._\-]){2}")
_CHUNK = re.compile(rf"[{_UNSPACED}][{_MARKS}]*|(?:(?![{_UNSPACED}])(?:[^\W_]|[{_MARKS}@$!*#%?']))+")
_LETTER = r"[^\W\d_]"
_JOINS = re.compile(rf"(?<={_LETTER})[_.\-*](?={_LETTER}(?!{_LETTER}))|(?<=(?<!{_LETTER}){_LETTER})[_.\-*](?={_LETTER})")
_JOINED = re.compile(rf"{_LETTER}[_.\-*]{_LETTER}\b")
#: Parts of a chunk that are words of their own, each of which may be of another script.
_PARTS = re.compile(r"((?<=[^\W_]{2})[\-/.,:;_&+]+(?=[^\W_]{2}))")
_LATIN = re.compile(r"[A-Za-z]")
_LATIN_MARKED = re.compile(rf"([A-Za-z])[{_MARKS}]+")
#: Ends of sentences that needn't have a blank behind them.
_STOPS = re.compile("[。！？｡｡۔؟।॥]+")
_NUMBER = re.compile(r"[\W_]*\d[\d.,:/%-]*(?:k|m|b|bn|mm|x|th|st|nd|rd|am|pm|d|h|s|yr|c|p|K|M|B|X)?[\W_]*")
_CAMEL = re.compile(r"[\W_]*([A-Z][a-z]+[A-Z][A-Za-z]*)(?:['’]s)?[\W_]*")
_CAMEL_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SYMBOL = re.compile(r"\W*?\$?([A-Z]{2,5})(?:[.-][A-Z])?(?:['’]s)?\W*")
_REPEAT = re.compile(r"(.)\1+")
#: What separates sentences besides a full stop.
_BREAKS = ("\n", "   ", " - ", " — ", " – ", "; ")
_END = re.compile(r"[.!?|][\"'”)*~_]*$")


def plain(word: str) -> str:
    """A word with every run of one letter reduced to one."""
    return _REPEAT.sub(r"\1", word)


def unmarked(word: str) -> str:
    """A word with marks taken from its Latin letters; those of other scripts stay, as they make other letters."""
    if word.isascii():
        return word
    return unicodedata.normalize("NFC", _LATIN_MARKED.sub(r"\1", unicodedata.normalize("NFD", word).translate(SPELT)))


class Reader:
    """Turns texts into sentences of normalised words; what a chunk between blanks stands for is kept.

    ``known`` are words that a masked or a spelled-out word may stand for. Short words in capitals are taken for names of
    stocks, except these and the ``usual`` ones, and except where the whole text is in capitals. Where ``tickers`` are given,
    only these are, and the words of a name in mixed case stand beside it.
    """

    def __init__(self, known: Iterable[str], usual: Iterable[str] = (), most_kept: int = 200_000, tickers: Iterable[str] | None = None):
        self.tickers = None if tickers is None else frozenset(tickers)
        self.known = frozenset(plain(w) for w in known if len(w) > 2)
        self.usual = self.known | frozenset(map(plain, usual))
        self.masked: dict[str, str] = {}
        for w in sorted(self.known):
            for k in range(len(w)):
                self.masked.setdefault(w[:k] + "*" + w[k + 1 :], w)
        self.kept: dict[str, tuple[str, ...]] = {}
        self.most_kept = most_kept

    def _word(self, raw: str) -> str:
        word = raw.strip("'!?")
        if not word:
            return ""
        if word.isalpha() or not word.isascii() and word[0].isalpha() and all(unicodedata.category(c)[0] in "LM" for c in word):
            return plain(word)
        if any(c in MASKS for c in word.strip("*#%?@")):
            shape = plain(re.sub(f"[{re.escape(MASKS)}]", "*", word.strip("*#%?")))
            if shape in self.masked:
                return self.masked[shape]
            fitting = self.masked.get(plain(re.sub(f"[{re.escape(MASKS)}]", "*", "".join(LEET.get(c, c) if c not in MASKS else c for c in word))))
            if fitting:
                return fitting
        if any(c.isalpha() for c in word) and not word[0].isdigit() or re.fullmatch(r"\d[a-z]\d*[a-z\d]*|[\d@$!]+[a-z]+[a-z\d@$!]*", word):
            return plain("".join(LEET.get(c, c) for c in word if c in LEET or c.isalpha()))
        return NUMBER if any(c.isdigit() for c in word) else ""

    def _folded(self, raw: str) -> str:
        """Without marks on Latin letters, and with look-alikes read as Latin ones: in words that mix scripts, and in those that
        are known words when read so."""
        if raw.isascii():
            return raw
        parts = _PARTS.split(unmarked(raw))
        for k, part in enumerate(parts):
            if not part.isascii() and (looks := part.translate(_LOOKS)) != part:
                if _LATIN.search(part) or any(self._word(w) in self.known for w in _CHUNK.findall(looks.lower()) if w.isascii()):
                    parts[k] = looks
        return "".join(parts)

    def _is_symbol(self, raw: str, capitals: str) -> bool:
        if raw[0] == "$":
            return self._word(_CHUNK.findall(raw.lower())[0]) not in self.known
        return plain(capitals.lower()) not in self.usual and (self.tickers is None or capitals in self.tickers)

    def _chunk(self, raw: str) -> tuple[str, ...]:
        """The words of what stands between blanks, and PAD where a sentence ends."""
        raw = self._folded(raw)
        if _NUMBER.fullmatch(raw):
            words = [NUMBER]
        elif (m := _CAMEL.fullmatch(raw)) and plain(m[1].lower()) not in self.usual:
            parts = [plain(w.lower()) for w in _CAMEL_PARTS.findall(m[1])]
            words = parts if self.known.intersection(parts) else [NAME] if self.tickers is None else [NAME, *parts]
        elif (m := _SYMBOL.fullmatch(raw)) and self._is_symbol(raw, m[1]):
            words = [NAME]
        else:
            low = raw.lower()
            joined = _JOINS.sub("", low) if _JOINED.search(low) else low
            words = [w for part in _CHUNK.findall(joined) if (w := self._word(part))]
        return (*words, PAD) if _END.search(raw) else tuple(words)

    def _spelled(self, m: re.Match) -> str:
        """Letters set apart, written together; a short end that isn't part of a known word stays apart."""
        letters = re.split(r"[ ._\-*·]", m[0])
        whole = self._folded("".join(letters))
        if len(letters[-1]) > 1 and plain(whole.lower()) not in self.known:
            rest = self._folded("".join(letters[:-1]))
            return f"{rest} {letters[-1]}" if plain(rest.lower()) in self.known else whole if len(letters) > 3 else m[0]
        return whole

    def sentences(self, text: str | None) -> list[list[str]]:
        """The words of each sentence; none for an empty text."""
        if not text:
            return []
        if not text.isascii():
            text = unicodedata.normalize("NFKC", _STOPS.sub(" . ", text)).translate(_INVISIBLE)
        if _SPACED_ONCE.search(text):
            text = _SPACED.sub(self._spelled, text)
        if text.isupper():
            text = text.lower()
        for mark in _BREAKS:
            if mark in text:
                text = text.replace(mark, " . ")
        out: list[list[str]] = [[]]
        kept = self.kept
        for raw in text.split():
            words = kept.get(raw)
            if words is None:
                if len(kept) > self.most_kept:
                    kept.clear()
                words = kept[raw] = self._chunk(raw)
            if words and words[-1] == PAD:
                out[-1].extend(words[:-1])
                out.append([])
            else:
                out[-1].extend(words)
        return [s for s in out if s]


# Phrases for training. They say what the labels mean in more words than a small sample of labels has: who is meant
# decides. Braces name the lists below; every list is stated as words of everyday use.

WORDS: dict[str, str] = {
    "slur": "idiot moron imbecile cretin fool simpleton dimwit halfwit dunce clown loser coward scumbag bastard asshole arsehole jackass dumbass "
    "dipshit shithead dickhead prick wanker tosser twat bitch rat pig weasel maggot worm toad leech snake dog donkey cockroach parasite scum trash garbage "
    "filth creep pervert liar thief fraud degenerate sociopath psychopath psycho freak failure wretch swine vermin numbskull airhead bonehead nitwit "
    "knucklehead lowlife douchebag shitbag scoundrel crook retch mutt ape goblin troll slut whore cunt",
    "bad": "stupid dumb worthless pathetic useless ignorant brainless braindead spineless gutless lying miserable disgusting filthy ugly crooked greasy illiterate "
    "sad demented toothless slimy rotten lazy clueless fucking damn goddamn ridiculous vile nasty cheap dirty fat bloody little",
    "you": "you|u|you people|you all|<name>|the op|op|the mods|the mod team|whoever wrote this|the author|this poster|that user|everyone here|your kind|the guy above",
    "tail": "||||and so are your friends|and everybody knows it|now get lost|go away|who should shut up|just like your mother|and always will be|with no brain|"
    "and nobody likes you|who deserves nothing|and i hope you lose everything|lol|you make me sick|get off this forum",
    "harm": "die|kys|kill yourself|hang yourself|drown|burn in hell|rot in hell|get hit by a bus|get cancer|choke|bleed|suffer|never wake up|lose your family|starve|jump off a bridge|drink bleach|"
    "fall down the stairs|get beaten up|end up in a ditch|cry yourself to sleep|go broke and die",
    "attack": "kill you|find you|hunt you down|beat you up|break your legs|break your neck|smash your face|burn your house down|cut your throat|shoot you|stab you|hurt your family|"
    "come to your house|make you pay|make you bleed|make you suffer|punch you in the mouth|wait for you outside|come for your kids|slap you|follow you home",
    "dehuman": "vermin|animals|parasites|subhuman|savages|a disease|a plague|a cancer|filth|scum|trash|garbage|criminals|thieves|rats|cockroaches|dirty|inferior|too stupid to vote|not human|evil by nature|"
    "lazy by blood|a stain on this country|all rapists and murderers|leeches|the enemy",
    "purge": "deport them all|send them back|wipe them out|ban them all|get rid of them|cleanse the country|lock them all up|gas them|throw them out|keep them out|never hire them|never rent to them|"
    "they deserve to die|they must be exterminated|they should be driven out|don't lend to them|they do not deserve rights|they should not be allowed to vote",
    "people": "foreigners|immigrants|migrants|refugees|women|muslims|jews|christians|hindus|blacks|whites|asians|gays|lesbians|gypsies|mexicans|africans|arabs|the poor|the disabled|northerners|southerners",
    "sex": "fuck you|bang you|ride you|suck you|lick you|spank you|undress you|strip you naked|make love to you|touch you all over|taste you|cum on you|do you from behind|eat you out|kiss your naked body|"
    "see you naked|see your tits|see your ass|rub your body|grab your ass|go down on you|take you to bed|rip your clothes off",
    "body": "dick|cock|penis|pussy|vagina|tits|boobs|breasts|nipples|ass|butt|naked body|cum|clit|balls",
    "porn": "nudes|naked pics|nude photos|porn|porn videos|sex tape|sex videos|xxx videos|cam show|webcam show|naked videos|milf videos|onlyfans nudes|dirty pics|hot girls|hot babes|escorts|live sex",
    "lust": "horny|wet|hard|naked|aroused|turned on|slutty|kinky|hot and wet|naughty",
    "thing": "stock|market|company|broker|chart|ticker|etf|fund|earnings call|algorithm|app|platform|balance sheet|position|trade|ceo|sector|index|dip|week|quarter|rally|option chain|print",
    "self": "i am|i'm|i was|i feel like|i felt like|i look like|call me|my wife says i am|my friends say i'm|i must be|guess i am|yes i am|turns out i am|we are all",
    "deed": "for buying the top|for selling too early|when it dropped|again|for holding this long|when the market fell|with my own money|for trusting that chart|this week|for not setting a stop|when the order filled",
    "mood": "fucking|damn|shitty|brutal|goddamn|bloody|stupid|ugly|insane|crazy|dumb|filthy|disgusting",
    "fact": "the lawsuit over sexual harassment was settled|the company was sued for discrimination|rules forbid insults and hate speech|please report abuse and threats to the mods|"
    "an adult entertainment company went public|police arrested a man who threatened the ceo|the article is about hate crimes|the documentary covers the porn industry|"
    "this forum bans racism and sexism|the breast cancer drug was approved|the poultry and pig farm stock is up|rat poison sales are rising|a bill against hate speech passed|"
    "a strip of puts costs less than a straddle|the naked puts expired|sex education funding was cut|the moderator removed abusive comments|pest control firms fight cockroaches and vermin|"
    "the parasite drug maker beat estimates|immigrants start many companies|women hold more index funds|refugees found work at the plant|the cock of the valve failed in the test|"
    "the killer app of the quarter|this trade is killing me|they killed it this quarter|bears got slaughtered|shorts will burn|gain porn|loss porn|chart porn|"
    "i want to see naked call premiums|my portfolio is bleeding|i got screwed by theta|the fed screwed us|get rich or die trying|hard assets are hot|"
    "a hard landing for the sector|dirty cash flow numbers|hot inflation data|the strip mall reit cut its dividend|animal spirits are back|plague of short sellers|"
    "the dog days of summer|the company kills its dividend|management is beating estimates|the fool newsletter|rat race|snake oil pitch for the stock|bull trap and bear trap",
}
POSITIVE: dict[str, Sequence[str]] = {
    "abuse": (
        "{you} are a {bad} {slur} {tail}", "{you} is a {bad} {slur} {tail}", "{you} is such a {slur} {tail}", "{you} are such {bad} {slur}s {tail}", "shut up you {bad} {slur} {tail}",
        "listen {slur} {tail}", "hey <name> you {bad} {slur}", "you {bad} {slur} {tail}", "what a {slur} {you} are", "only a {bad} {slur} would post this", "nobody asked you {slur}",
        "look at this {bad} {slur} posting again", "<name> posting again {bad} {slur}", "go {harm} you {slur}", "i hope you {harm} {tail}", "you should {harm}", "please {harm} {tail}", "do the world a favor and {harm}",
        "i will {attack} {tail}", "i am going to {attack}", "somebody should {attack}", "one day i will {attack} <name>", "<name> i will {attack}", "i know where you live", "i am coming for you and your family", "watch your back <name>",
        "you will {harm}", "you better sleep with one eye open", "the world would be better without you", "nobody would miss you if you died", "you do not deserve to live",
        "your mother should have aborted you", "your family must hate you {slur}", "cry more {slur} {tail}", "eat shit {slur}", "fuck you {slur} {tail}", "fuck off you {slur}", "go to hell {slur}",
        "mods here are {bad} {slur}s {tail}", "the mods are {slur}s", "the op is a {slur} {tail}", "<name> is a {slur} with the brain of a {slur}", "{you} {bad} {slur} {tail}", "delete your account {slur} {tail}",
        "i would love to {attack}", "people like you should {harm}", "{bad} {slur} like you should be banned {tail}", "how {bad} are you {slur}", "whoever upvoted this is a {slur} {tail}",
    ),
    "hate": (
        "{group} are {dehuman}", "all {group} are {dehuman} {purge}", "typical {group} {dehuman}", "{group} {purge}", "never trust {group} they are {dehuman}", "{group} are {dehuman} and should be thrown out",
        "the {group} are {dehuman} and run the banks", "keep {group} out of our country", "we should {purge} the {group}", "{group} on this forum are {dehuman}", "i hate {group} {purge}",
        "{group} breed like {slur}s", "i would never hire {group}", "this country was fine until the {bad} {group} arrived", "everyone knows {group} are {dehuman} {purge}", "{group} do not deserve rights",
        "i said it before {group} are {dehuman} every one of them", "{group} deserve what is coming", "{bad} {group} ruin everything {purge}", "as long as {group} are here they stay {dehuman}", "{group} are too stupid to own anything",
        "no {group} in our towns", "{group} should be exterminated", "blame the {group} they are the reason we are poor", "their whole kind is {dehuman}",
    ),
    "sexual": (
        "i want to {sex}", "let me {sex}", "i would love to {sex} all night", "i am so {lust} i want to {sex}", "so {lust} tonight let me {sex}", "<name> come over and i will {sex}", "dreaming that i {sex}", "my ex used to {sex}",
        "free {porn} on my page", "selling {porn} cheap write me", "join my {porn} tonight", "message me for {porn}", "paid {porn} then we {sex}", "hot {lust} babe ready to {sex}", "anyone {lust} tonight message me for {porn}",
        "looking at her {body}", "my {body} gets {lust} when i think of her", "play with my {body}", "send me a video of you naked", "send me {porn}", "touching yourself on camera", "i take everything off on camera",
        "she sucked my {body}", "he licked her {body}", "we had sex all night", "{lust} and waiting in bed", "her bare {body}", "show me your {body}", "i jerk off to her", "let me cum on your {body}", "{lust} girls with big {body}",
    ),
}
NEGATIVE: Sequence[str] = (
    "{self} a {bad} {slur} {deed}", "{self} such a {slur} {deed}", "{bad} me bought it {deed}", "that {slur} in the mirror bought {deed}", "what a {bad} {thing}", "the {thing} is {mood} {bad}", "this {bad} {thing} {deed}",
    "this {thing} is a {slur}", "that {thing} is {mood} garbage", "the {thing} looks like shit {deed}", "holy shit the {thing} {deed}", "the {thing} was fucking {mood} {deed}", "<name> has a {bad} balance sheet", "a {bad} {slur} of a {thing}",
    "fuck this {thing}", "the {thing} beat the shit out of estimates", "the {thing} is killing me", "{fact}", "{fact}", "{fact}", "{fact}", "{self} dumb {deed}", "{self} {bad} {deed}", "my {bad} {thing} died {deed}",
    "you are a genius for holding the {thing}", "you are right about the {thing}", "you should sell the {thing}", "i hope you make money {deed}", "i will find a better {thing}", "i want to buy the {thing}", "i want to see the {thing} go up",
    "people like you make this forum better", "everyone knows the {thing} is rigged", "the {thing} should be thrown out of the index", "let me see the {thing}", "send me the {thing} report", "free videos about the {thing} on my page", "join my live show about the {thing} tonight",
    "the mods are great here", "the op is right about the {thing}", "listen to the earnings call", "the world would be better without this {thing}", "never trust the {thing}", "the {thing} apes hold together", "retards together strong {deed}",
    "selling naked calls on the {thing} is risky", "naked puts blow up accounts {deed}", "i never write naked options", "naked call premiums are rich on this {thing}", "accounts die on naked calls", "they have guided {thing} lower", "told you so about the {thing}",
    "sad day for the {thing}", "my {thing} is trash and i know it", "my wife thinks my {thing} is garbage and she is right", "my picks are trash {deed}", "the {thing} will die", "options die worthless {deed}", "who else holds the {thing}", "we like the {thing}", "diamond hands or die", "{self} a degenerate gambler {deed}", "{self} an ape {deed}", "my {thing} makes me want to cry", "hot {thing} ready to run all night", "waiting in bed for the {thing} to open",
)
#: Phrases of the other languages that the documents and posts are written in, by label; the labelled sample may hold English only.
FOREIGN: dict[str, str] = {
    "abuse": "du bist ein dummer idiot|halt die klappe du arschloch|ihr seid alle blöde schweine|ich hoffe du stirbst|verpiss dich du wichser|ich bringe dich um|bring dich um du versager|"
    "eres un idiota|cállate imbécil de mierda|vete a la mierda hijo de puta|ojalá te mueras|te voy a matar|sois todos unos estúpidos|mátate ya basura|"
    "tu es un idiot|ferme ta gueule connard|va te faire foutre espèce de salaud|j'espère que tu vas crever|je vais te tuer|vous êtes tous des imbéciles|va mourir sale merde|"
    "você é um idiota|cala a boca seu imbecil|vai se foder seu filho da puta|espero que você morra|eu vou te matar|vocês são uns burros|se mata seu lixo|"
    "ты тупой идиот|заткнись придурок|пошёл нахуй мудак|чтоб ты сдох|я тебя убью|вы все дебилы и уроды|убей себя тварь|иди на хер сука|"
    "你是个白痴|闭嘴你这个蠢货|你这个混蛋去死吧|我要杀了你|你们都是垃圾|滚出去傻逼|操你妈|希望你全家死光",
    "hate": "alle ausländer sind ungeziefer|juden sind ratten und gehören vernichtet|frauen sind minderwertig|werft die flüchtlinge raus|"
    "los inmigrantes son basura|las mujeres son inferiores|hay que exterminar a los judíos|fuera los moros de aquí son ratas|"
    "les immigrés sont de la vermine|les femmes sont inférieures|il faut exterminer les juifs|dehors les arabes ce sont des rats|"
    "os imigrantes são um lixo|as mulheres são inferiores|temos que exterminar os judeus|fora os negros daqui são ratos|"
    "все мигранты твари|женщины тупые и низшие|евреев надо уничтожить|гнать этих чурок отсюда они крысы|移民都是害虫|女人都是低等的|犹太人应该被消灭|把外国人都赶出去他们是老鼠",
    "sexual": "ich will dich die ganze nacht ficken|zeig mir deine titten|verkaufe nacktbilder|ich bin so geil|quiero follarte toda la noche|enséñame las tetas|vendo fotos desnuda|estoy muy cachonda|"
    "je veux te baiser toute la nuit|montre-moi tes seins|je vends des photos nue|je suis toute excitée|quero te foder a noite toda|me mostra seus peitos|vendo fotos pelada|estou com muito tesão|"
    "хочу трахать тебя всю ночь|покажи сиськи|продаю голые фото|я такая возбуждённая|我想整夜操你|给我看你的胸|出售裸照|我好想和你做爱",
    "none": "die aktie ist heute gefallen|ich habe gekauft und warte auf die zahlen|wer weiß warum der markt steigt|ich idiot habe zu früh verkauft|der kurs ist scheiße|die regeln verbieten beleidigungen|"
    "la acción cayó hoy|compré más y espero los resultados|alguien sabe por qué sube el mercado|qué idiota soy por vender antes|el precio es una mierda|las normas prohíben los insultos|"
    "l'action a baissé aujourd'hui|j'ai acheté et j'attends les résultats|quelqu'un sait pourquoi le marché monte|quel idiot je suis d'avoir vendu|le cours est à chier|les règles interdisent les insultes|"
    "a ação caiu hoje|comprei mais e espero o resultado|alguém sabe por que o mercado sobe|que idiota eu sou por vender cedo|o preço está uma merda|as regras proíbem insultos|"
    "акция сегодня упала|я купил ещё и жду отчёта|кто знает почему рынок растёт|какой я идиот что продал рано|цена говно|правила запрещают оскорбления|дивиденды обещали повысить в следующем году|рынок очень слабый объёмы маленькие|"
    "股票今天下跌了|我买了一些等财报|有人知道市场为什么上涨吗|我真是个白痴卖早了|这个价格真垃圾|规则禁止辱骂|这家公司的利润比去年低很多|市场情绪很差先观望吧",
}


def foreign_phrases() -> list[tuple[str, str]]:
    """(phrase, label) pairs in the other languages."""
    return [(text, label) for label, phrases in FOREIGN.items() for text in phrases.split("|")]


def _lists() -> dict[str, list[str]]:
    return {k: v.split("|") if "|" in v else v.split() for k, v in WORDS.items()}


def alike_words() -> dict[str, list[str]]:
    """Of single words that say what kind of person or thing is meant, the others of their list."""
    lists = _lists()
    return {plain(w): alike for k in ("bad", "slur", "body", "lust", "thing", "people") if (alike := [plain(x) for x in lists[k] if x.isalpha()]) for w in lists[k] if w.isalpha()}


def loaded_words() -> set[str]:
    """Single words that make a phrase worth a second look."""
    lists = _lists()
    return {*lists["slur"], *(w for k in ("dehuman", "body", "porn", "lust") for w in lists[k] if w not in ("hard", "wet")), *"fuck fucking kill die shit suck bang naked nudes rot choke bleed immigrants foreigners hate".split()}


def known_words() -> set[str]:
    """Single words that a masked or spelled-out word may stand for."""
    lists = _lists()
    phrases = [p for k in ("slur", "bad", "harm", "attack", "dehuman", "sex", "body", "porn", "lust", "people") for p in lists[k]]
    return {w for p in [*phrases, *(f for frames in POSITIVE.values() for f in frames)] for w in re.findall("(?<![a-z{])[a-z]{3,}(?![a-z}])", p)}


def _group(rng: random.Random) -> str:
    """A name for people that no list has."""
    made = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    return made + rng.choice(["ns", "ites", "ians", "folk", "landers", "ers", "is", "ese", "s"])


def made_up(amount: int, seed: int = 0) -> list[tuple[str, str]]:
    """(phrase, label) pairs, about half of them clean."""
    rng = random.Random(seed)
    lists = _lists()

    def fill(frame: str) -> str:
        for _ in range(3):
            frame = re.sub(r"\{(\w+)\}", lambda m: rng.choice(lists["people"]) if m[1] == "group" and rng.random() < 0.4 else _group(rng) if m[1] == "group" else rng.choice(lists[m[1]]), frame)
        return " ".join(frame.split())

    out = []
    for _ in range(amount):
        label = rng.choices(["none", "abuse", "hate", "sexual"], [9, 5, 3, 3])[0]
        out.append((fill(rng.choice(NEGATIVE if label == "none" else POSITIVE[label])), label))
    return out
