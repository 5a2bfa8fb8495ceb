"""Character classes and symbols. Fixed values, in the order in which they are usually listed."""

HEAD = "▁"
UNK = "<unk>"

#: Letters that symbol splitting leaves together (Java regular-expression class body); a blank is one of them.
LETTERS = r"\p{IsHiragana}\p{IsKatakana}ー\p{IsHan}〇一二三四五六七八九a-zA-Z "
#: Characters of Japanese script, and a blank.
SCRIPT = r"\p{IsHiragana}\p{IsKatakana}ー\p{IsHan}〇一二三四五六七八九 "
#: ASCII and JIS symbols.
ASCII_SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
JIS_SYMBOLS = "、。，．・：；？！゛゜´｀¨＾￣＿ヽヾゝゞ〃仝々〆〇ー―‐／＼～∥｜…‥‘’“”（）〔〕［］｛｝〈〉《》「」『』【】＋－±×÷＝≠＜＞≦≧∞∴♂♀°′″℃￥＄￠￡％＃＆＊＠§☆★○●◎◇◆□■△▲▽▼※〒→←↑↓〓∈∋⊆⊇⊂⊃∪∩∧∨￢⇒⇔∀∃∠⊥⌒∂∇≡≒≪≫√∽∝∵∫∬Å‰♯♭♪"
SYMBOLS = ASCII_SYMBOLS + JIS_SYMBOLS
#: Runs are split between these: a backslash is not one of them.
RUN_SYMBOLS = SYMBOLS.replace("\\", "")
#: Special tokens that open a vocabulary table.
SPECIALS = ("<unk>", "<s>", "</s>", "<mask>", "<pad>", "<CLS>", "<SEP>", "<EOD>")
LONGEST_RUN = 24


def char_class(characters: str) -> str:
    """A regular-expression class of these characters, each escaped that needs it."""
    return "[" + "".join("\\" + c if c in "\\[]^-&~|" else c for c in characters) + "]"
