"""Fixed word lists. Each operator has its own; results depend on the exact members."""

# Words that keyword extraction leaves out.
KEYWORD_STOP = """
the a an of to from in on at by for and or is are was were be been being this that these those it its with as it's we
our their they them than into about above below report say says will would can could should may might must have has had
do does did not no so if then else when where which who whom how what why all any each per via using used use new now
also more most other some such only over under between within
""".split()

# Words that retrieval and the local judge leave out.
RETRIEVAL_STOP = """
what which how the a an is are was were does did do in on at to for of and or by with from this that these those it its
be been being have has had will would could should may might must shall can cannot dont doesnt report describe say says
said describes according year annual global
""".split()

# Words that are no part of a figure's label.
LABEL_FILLERS = "the a an of to from and is was are now all with at by in on after down up for then it its this that we our".split()

# Words after which a bare count is a reference, not a figure.
REFERENCE_WORDS = "figure fig table section sec chapter page eq equation appendix part step item line note footnote ref version no vol".split()

# Words of a question that carry no content.
QUESTION_FILLERS = """
the a an of to from in on at by for and or is was are were what which how many much does did do this that it its with as
be you your we our there per
""".split()

# Modifiers that a key number's label may have more than the question.
SOFT_WORDS = "avg average mean median total overall gross net monthly annual yearly daily number count amount value".split()

# Markers of routes and gates, as substrings of the lower-case question.
SUMMARY_MARKERS = ["summarise", "summarize", "summary", "what is this", "overview", "about"]
INSIGHT_MARKERS = ["insight", "finding", "key finding", "takeaway", "conclusion"]
COMPLEX_MARKERS = [" all ", "list ", " every ", "what are", "compare", "how does", "how do ", "say about", "explain", "describe", "discuss", "differ", "versus", " vs "]
ENUMERATION_MARKERS = [" all ", "list ", " every ", "what are"]

# Markers of a refusal, as substrings of the lower-case first 160 characters of an answer.
REFUSAL_MARKERS = [
    "not found", "don't contain", "do not contain", "does not contain", "doesn't contain", "didn't contain", "don't include",
    "do not include", "doesn't include", "does not include", "no information", "i'm sorry", "i am sorry", "cannot find",
    "could not find", "couldn't find", "no relevant information", "not provided in", "isn't provided", "is not provided", "no mention",
]
