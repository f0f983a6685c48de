"""Characters that show nothing."""

from __future__ import annotations

# Characters outside the class of format characters that show nothing: the grapheme joiner, the Hangul and
# half-width fillers, Khmer inherent vowels, variation selectors.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
