"""Every operator as a runnable query over the star tables, with its SQL counterpart."""
