"""Training-data operators over the texts, embeddings and dialogues of captured documents."""
