"""Sources of raw events, blocks and contract interfaces."""
