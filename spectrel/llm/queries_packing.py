from spectrel.llm import common, packing


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pack(spark, sf_dir):
    return packing.pack_digests(common.table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), size=4096, end_id=2)
