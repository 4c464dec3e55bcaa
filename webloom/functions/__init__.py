"""Column functions (URL, HTML, tokenizer, bfloat16); none of them runs Python per row."""
