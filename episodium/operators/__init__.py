"""DataFrame operators over episodes, steps, objects, prompts, frames and runs."""
