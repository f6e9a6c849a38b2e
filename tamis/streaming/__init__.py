"""The moderation worker as Structured Streaming: no polling, no sets of handled ids in a process's memory."""
