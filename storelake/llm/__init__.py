"""Training-data operators: dedup, quality, mixing, chat, secrets, tokenisation, licences."""
