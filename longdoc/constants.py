"""Fixed values the operators share.

Fixed values (they must equal the reference's defaults for equal results):
chunk size 64, neighbours per query 2, maximum sequence length 512,
train batch size 8, test batch size 1, shuffle seed 42,
top-k filter threshold 0.9, metric rounding 4 digits.
Ids of this build: PAD 0, EOS 1, UNK 2 (only for its literal string); real
tokens start at 3: WORD 3 begins a word that is spelled in bytes, 4 to 259 are
the bytes, and from 260 on come the pieces of the vocabulary.
Special token strings: "<pad>", "</s>", "<unk>".
"""

PAD = 0
EOS = 1
UNK = 2
FIRST_REAL_ID = 3
WORD = 3
FIRST_BYTE_ID = 4
FIRST_PIECE_ID = FIRST_BYTE_ID + 256

PAD_TOKEN = "<pad>"
EOS_TOKEN = "</s>"
UNK_TOKEN = "<unk>"
SPECIAL_TOKENS = (PAD_TOKEN, EOS_TOKEN, UNK_TOKEN)

CHUNK_SIZE = 64
N_NEIGHBORS = 2
MAX_LEN = 512
BATCH_SIZE = 8
TEST_BATCH_SIZE = 1
SEED = 42
FILTER_THRES = 0.9
# frequent pieces with an id of their own; all others are spelled, so this sets
# the compression only
VOCAB_SIZE = 32000

# whitespace used by the word splitter: space, tab, newline, carriage return
WS_REGEX = "[ \t\n\r]+"
