"""Fixed values of the dialogue rules: cues, tags, opposed tags, leanings and probes."""

# Fixed values, in their order.

#: Keywords, of which any in the lower-case text gives the tags.
ATTRIBUTE_RULES = (
    (("quiet",), ("negative-space", "muted-palette", "quiet")),
    (("negative space",), ("negative-space",)),
    (("lone",), ("lone-subject",)),
    (("symmetry", "symmetric"), ("symmetry",)),
    (("warm",), ("warm-tones",)),
    (("contrast",), ("high-contrast",)),
    (("breathing",), ("breathing-room",)),
    (("texture", "textured"), ("texture",)),
    (("motion", "movement"), ("motion",)),
    (("repetition", "repeating"), ("repetition",)),
    (("minimal",), ("minimal",)),
    (("busy", "crowded", "chaotic"), ("dense",)),
    (("geometric",), ("geometric",)),
    (("organic",), ("organic",)),
    (("nostalgic",), ("nostalgic",)),
    (("heavy",), ("heavy",)),
    (("light",), ("light",)),
)

#: Cues of dislike, which come before those of like.
DISLIKE_CUES = ("hate", "don't", "dislike", "ugly", "awful", "bad")
LIKE_CUES = ("love", "like", "beautiful", "great", "gorgeous")

#: A word's tags; the first is its own.
WORD_ATTRIBUTES = (
    ("quiet", ("negative-space", "muted-palette")),
    ("empty", ("negative-space", "breathing-room")),
    ("breathing", ("breathing-room",)),
    ("busy", ("dense",)),
    ("crowded", ("dense",)),
    ("chaotic", ("dense",)),
    ("warm", ("warm-tones",)),
    ("minimal", ("minimal",)),
    ("minimalist", ("minimal",)),
    ("symmetry", ("symmetry",)),
    ("symmetric", ("symmetry",)),
    ("lone", ("lone-subject",)),
    ("contrast", ("high-contrast",)),
    ("texture", ("texture",)),
    ("textured", ("texture",)),
    ("motion", ("motion",)),
    ("movement", ("motion",)),
    ("repetition", ("repetition",)),
    ("repeating", ("repetition",)),
    ("geometric", ("geometric",)),
    ("organic", ("organic",)),
    ("nostalgic", ("nostalgic",)),
    ("heavy", ("heavy",)),
    ("light", ("light",)),
)

#: Opposed tags: a tension where both are liked.
CONTRAST_PAIRS = (("minimal", "dense"), ("light", "heavy"), ("negative-space", "dense"))

#: How a tag leans on signals; vibrancy follows colorfulness.
ATTRIBUTE_SIGNALS = {
    "negative-space": {"colorfulness": -0.3, "aesthetic_quality": 0.2},
    "muted-palette": {"colorfulness": -0.5},
    "lone-subject": {"aesthetic_quality": 0.3, "pairing_affinity": -0.2},
    "symmetry": {"harmony": 0.5, "aesthetic_quality": 0.2},
    "warm-tones": {"colorfulness": 0.4, "harmony": 0.3},
    "high-contrast": {"technical_quality": 0.3, "colorfulness": 0.2},
    "breathing-room": {"aesthetic_quality": 0.3, "colorfulness": -0.2},
    "texture": {"technical_quality": 0.4},
    "motion": {"aesthetic_quality": 0.2, "technical_quality": -0.2},
    "repetition": {"harmony": 0.4, "pairing_affinity": 0.3},
    "minimal": {"colorfulness": -0.4, "harmony": 0.3},
    "dense": {"colorfulness": 0.4, "harmony": -0.2},
    "geometric": {"harmony": 0.4, "technical_quality": 0.2},
    "organic": {"harmony": 0.2, "colorfulness": 0.2},
    "nostalgic": {"colorfulness": -0.2},
    "quiet": {"colorfulness": -0.4, "aesthetic_quality": 0.2},
    "heavy": {"colorfulness": 0.2, "aesthetic_quality": -0.1},
    "light": {"colorfulness": -0.1, "aesthetic_quality": 0.2},
}

#: Cue tag, gap tag, question.
PROBES = (
    ("negative-space", "symmetry", "Is it the emptiness on the left, or the symmetry?"),
    ("negative-space", "lone-subject", "Is it the empty space, or the lone subject within it?"),
    ("quiet", "texture", "Is it the quiet stillness, or the texture?"),
    ("muted-palette", "warm-tones", "Is it the muted palette, or the warm tones?"),
    ("lone-subject", "breathing-room", "Is it the lone subject, or the breathing room around it?"),
    ("symmetry", "geometric", "Is it the symmetry, or the geometry?"),
    ("minimal", "dense", "Is it the minimalism, or the busyness?"),
    ("warm-tones", "high-contrast", "Is it the warm tones, or the contrast?"),
    ("texture", "organic", "Is it the texture, or the organic feel?"),
    ("breathing-room", "negative-space", "Is it the breathing room, or the emptiness?"),
    ("geometric", "repetition", "Is it the geometry, or the repetition?"),
    ("motion", "repetition", "Is it the motion, or the repetition?"),
    ("heavy", "light", "Is it the weight, or the lightness?"),
    ("nostalgic", "muted-palette", "Is it the nostalgia, or the muted palette?"),
    ("dense", "motion", "Is it the busyness, or the motion?"),
)
OPENING_PROBE = "What draws you to this image?"

#: Least uses of a tag in a pattern, liked picks of a history claim, and size of its lean; the
#: contrast where nothing was disliked; the weight of claims that nobody spoke.
LEAST_USES, LEAST_PICKS, LEAST_LEAN, NEUTRAL, UNSPOKEN = 2, 2, 0.1, 0.5, 0.25
