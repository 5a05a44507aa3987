"""Values that results depend on."""

# Fixed values of the archive format and its policies.
KIB, MIB = 1024, 1024 * 1024
MAGIC, FORMAT_VERSION = b"CZP3", 1
CODEC_STORE, CODEC_ZSTD, CODEC_ZLIB = 0, 1, 2
SPAN_LAST, SPAN_MICRO, SPAN_STORE, SPAN_DNA, SPAN_PI, SPAN_HIGHENT = 1, 2, 4, 8, 16, 32
CHUNK_SIZE, PROBE_BYTES, PROBE_LEVEL = 256 * KIB, 64 * KIB, 1
THRESHOLD, THRESHOLD_SMALL, SMALL_SIZE = 0.05, 0.02, 256 * KIB
WHOLE_MAX, MIN_GAIN = 32 * MIB, 0.02
FAST_PROBE_BYTES, FAST_PROBE_LEVEL, FAST_BIG_FILE, FAST_BIG_CHUNK = 16 * KIB, 1, 8 * MIB, MIB
MICRO_CUTOFF, MICRO_BLOCK_MAX, MICRO_ENTRY_MAX = 64 * KIB, 4 * MIB, 4096
MOTIF_LENGTH, MOTIF_MAX, MOTIF_MIN, MOTIF_SCORE = 32, 512, 16, 0.12
FLOORS = {"text": 0.0, "doc": 0.03, "bin": 0.12, "media": 0.30}
PI_SIMILAR, PI_BYPASS, PI_CANDIDATES, PI_MIN, PI_MAX = 0.20, 0.80, 4, 32 * KIB, 256 * MIB
PI_BUCKET_BITS, PI_BUCKET_KEPT = 12, 128
DNA_MAX = 256 * MIB
BH_LOW, BH_HIGH, BH_POWER, BH_BUMP = 0.965, 0.995, 2, 0.20
EMA_ALPHA, EMA_STEP, EMA_TARGET, BIAS_LOW, BIAS_HIGH = 0.12, 0.010, 0.06, -0.05, 0.20
CHUNK_OVERHEAD = 96
MEDIA_OFFSETS = (0.0, 0.25, 0.75)
FORCED_ENTROPY, UNGATED_ENTROPY = 7.95, 0.5
AUTO_FILES, AUTO_ENTROPY, AUTO_GAIN, AUTO_SCORE = 64, 0.97, 0.03, 0.35
SECTION_HEADER, CHUNK_HEADER = 12, 56
#: crc32 of four bytes from a register of all ones is their crc32 xor this.
SEEDED_CRC = 0xDEBB20E3

# Fixed lists of extensions.
FAST_MEDIA = "png jpg jpeg webp gif bmp tga mp4 mkv avi mov webm mp3 ogg flac wav zip 7z rar gz bz2 xz zst pak wad dat bin iso jar class".split()
TEXT_LIKE = "txt md json xml yaml yml csv tsv log ini cfg py js ts css html htm c cpp h hpp rs go java cs tex rtf srt ass".split()
CLASS_TEXT = TEXT_LIKE + "rst conf toml cc php rb pl lua sql sh bat ps1 nut lng make mk cmake gradle bazel bzl".split()
CLASS_DOC = "pdf doc docx ppt pptx xls xlsx odt odp ods rtf epub".split()
CLASS_MEDIA = "jpg jpeg png gif bmp webp tif tiff heic mp4 mov m4v webm mkv avi wmv flv mp3 aac m4a ogg opus flac wav zip 7z rar gz bz2 xz zst".split()
CONTAINERS = "mp4 m4v mov mkv webm avi mp3 m4a aac flac ogg jpg jpeg png gif webp heic heif zip 7z rar gz bz2 xz zst lz4 pdf docx pptx xlsx".split()
