"""White space as the transcripts count it."""

# The space characters of the transcripts, for use inside brackets of a pattern. Java's
# own class has only the first six.
SPACE_CHARS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{SPACE_CHARS}]"
EDGES = f"^{SPACE}+|{SPACE}+$"
